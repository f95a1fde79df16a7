"""Languages of posts and of their blocks.

Text is stripped of what has no language (code, links, numbers, markup, names as far as their place
tells them), split into sentences, and each sentence goes to the language model with the lowest cross
entropy per character. Confidence is calibrated on held-out sentences, against names and scrambled
words for rejection; a sentence with a confidence below one half has no language. A block has the
language most of its words are in, and so has a post.
"""

from __future__ import annotations

import functools
import html
import pickle
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.kneser_ney import CharModels

#: Bounds of what the models are fitted on: labelled sentences (lang_samples holds 300); labelled posts, and
#: characters of them; names of authors.
MAX_SAMPLES, MAX_POSTS, MAX_POST_CHARACTERS, MAX_NAMES = 20_000, 12_000, 50_000_000, 2_000
#: Characters of posts a task judges at once.
AT_ONCE = 4_000_000
# The bibliographic three-letter codes, where they differ from the terminological ones.
BIBLIOGRAPHIC = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de", "gre": "el",
    "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}
# Latin letters without an accent that decomposes, and Cyrillic written in Latin letters.
PLAIN = {"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"}
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
OTHER_TRANSLITERATION = {"ё": "e", "й": "j", "х": "h", "ц": "c", "щ": "shch", "ю": "ju", "я": "ja", "ь": "'"}

# What no language is in: code, links, markup, lines that introduce a quote, signatures, words with digits.
# Every pattern is linear in the text, however long a line or word is.
_FENCES = re.compile(r"```.*?(?:```|\Z)|\[code[^\]]*\].*?(?:\[/code\]|\Z)|<(pre|code)\b[^>]*>.*?(?:</\1>|\Z)|\[img[^\]]*\].*?(?:\[/img\]|(?=\n))", re.S | re.I)
_LINK = re.compile(r"(?:[hH][tT][tT][pP][sS]?://|[fF][tT][pP]://|[wW][wW][wW]\.)[^\s\[\]<>\"]+")
_ADDRESS = re.compile(r"(?<!\S)\S[^\s@]*+@\S+\.\w+")
_BREAK = re.compile(r"\[(?:/?quote|/?blockquote)[^\]\n]*\]|</?blockquote[^>]*>|<br\s*/?>|</?p\b[^>]*>|</?div\b[^>]*>", re.I)
_TAG = re.compile(r"<[^<>\n]+>|\[/?[a-z*]+(?:=[^\]\n]*)?\]", re.I)
_REMOVED = re.compile(r"\[(?:deleted|removed)[^\]]*\]|<(?:deleted|removed)>", re.I)
_SAID = re.compile(r"^[>| \t]*+[^\s\d]*+\d[^\n]*:[ \t]*$", re.M)
_BRACKETED = re.compile(r"\((?=[^()\n\d]*+\d)[^()\n]*+\)|@\w+")
_SIGNED = re.compile(r"^[ \t]*(?:--|_{3,})[ \t]*\n[^\n]*", re.M)
_QUOTED = re.compile(r"^[ \t]*(?:[>|][ \t]?)+", re.M)
_NO_WORD = "_/\\#=|"  # signs, beside digits, that no word holds
_SENTENCE = re.compile(r"[.!?…:]++(?=\s|$)|\n\s*\n|\x00")
_LINE_END = re.compile(r"\r\n|\r|\n")
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}']+")
# Marks between the sentences and the blocks of posts that are read together.
_NEXT_SENTENCE, _NEXT_BLOCK = "\x03", "\x02"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, a mark, an apostrophe or a separator of ours, else a blank."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    kept = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM"]
    kept += [ord(x) for x in ("'", _NEXT_SENTENCE, _NEXT_BLOCK)]
    table[kept] = kept
    return table


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point 1 if it is white space, 2 if it makes what it stands in no word."""
    table = np.zeros(0x110000, dtype=np.uint8)
    table[[c for c in range(0x110000) if chr(c).isspace()]] = 1
    table[[c for c in range(0x110000) if chr(c).isdecimal() or chr(c) in _NO_WORD]] = 2
    return table


def _words_only(text: str) -> str:
    """Lower case, words of letters only, one blank between them."""
    raw = np.frombuffer(unicodedata.normalize("NFC", text.lower()).replace("’", "'").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _kinds()[raw]
    space = kind == 1
    word = np.cumsum(space)
    no_word = np.zeros(int(word[-1]) + 1 if len(word) else 1, dtype=bool)
    no_word[word[kind == 2]] = True
    codes = _letters()[raw]
    codes[no_word[word] & ~space] = 32
    blank = codes == 32
    blank[1:] &= blank[:-1]
    blank[:1] = False
    return codes[~blank].tobytes().decode("utf-32-le", "surrogatepass")


def normal(text: str) -> str:
    """Lower-case words of letters and apostrophes with single blanks between."""
    text = unicodedata.normalize("NFC", text.lower()).replace("’", "'")
    return " ".join(_NO_LETTER.sub(" ", text).split())


class _Plain(dict):
    """Translation of single characters, filled as they are met."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if ch == "ё":
            out = "е"
        elif "Ѐ" <= ch <= "ӿ":
            out = ch
        else:
            out = PLAIN.get(ch) or "".join(x for x in unicodedata.normalize("NFD", ch) if not unicodedata.combining(x))
        self[code] = out
        return out


_PLAIN = _Plain()


def plain(text: str) -> str:
    """Latin letters without their accents; of Cyrillic only ё becomes е."""
    return text.translate(_PLAIN)


@functools.lru_cache(maxsize=100_000)
def spellings(text: str) -> tuple[str, ...]:
    """A normalised sentence as it is also met: accents lost, Cyrillic in Latin letters."""
    out = {text, plain(text)}
    if re.search("[а-я]", text):
        first = str.maketrans(TRANSLITERATION)
        second = str.maketrans(TRANSLITERATION | OTHER_TRANSLITERATION)
        out |= {text.translate(first), normal(text.translate(second)), text.replace("щ", "shch").translate(first)}
    return tuple(sorted(out))


def blocks_of(text: str) -> list[str]:
    """Blocks of a post: runs of lines that aren't blank, in order. Code is blanked out in place, so that it
    doesn't change the numbering, and so are removed posts."""
    keep_lines = lambda m: re.sub(r"[^\r\n]", "\x01", m[0])
    if "`" in text or "[" in text or "<" in text:
        text = _FENCES.sub(keep_lines, text)
    out: list[list[str]] = []
    open_block = False
    for line in _LINE_END.split(text) if "\r" in text else text.split("\n"):
        if line.strip():
            if not open_block:
                out.append([])
            out[-1].append(line)
            open_block = True
        else:
            open_block = False
    return ["\n".join(b) for b in out]


def sentences_of_all(blocks: list[str]) -> list[list[str]]:
    """Normalised sentences of each block, without what has no language. The blocks go through each
    pattern together."""
    if not blocks:
        return []
    t = "".join(blocks)
    if _NEXT_BLOCK in t or _NEXT_SENTENCE in t:
        blocks = [b.replace(_NEXT_BLOCK, " ").replace(_NEXT_SENTENCE, " ") for b in blocks]
    t = f"\n{_NEXT_BLOCK}\n".join(blocks).replace("\x01", " ")
    if "&" in t:
        t = html.unescape(html.unescape(t)).replace("\xa0", " ")
    t = _ADDRESS.sub(" ", _LINK.sub(" ", _REMOVED.sub(" ", t)))
    t = _TAG.sub("", _BREAK.sub("\x00", t))
    t = _SIGNED.sub("\x00", _SAID.sub("\x00", t))
    t = _BRACKETED.sub(" ", _QUOTED.sub("", t))
    t = _SENTENCE.sub(f" {_NEXT_SENTENCE} ", t)
    return [[s for part in b.split(_NEXT_SENTENCE) if (s := part.strip(" "))] for b in _words_only(t).split(_NEXT_BLOCK)]


def sentences_of(block: str) -> list[str]:
    return sentences_of_all([block])[0]


@functools.cache
def _language_names(spark: SparkSession) -> dict[str, str]:
    locale = spark._jvm.java.util.Locale
    out = {}
    for code in locale.getISOLanguages():
        one = locale.forLanguageTag(code)
        out |= {one.getDisplayLanguage(locale.ENGLISH).lower(): code, one.getISO3Language(): code}
    return out | BIBLIOGRAPHIC | {code: code for code in locale.getISOLanguages()}


def label_languages(spark: SparkSession) -> dict[str, str]:
    """Two-letter code of each spelling of a language: its codes of two and three letters and its English
    name, in lower case, from the platform's table of ISO 639."""
    return dict(_language_names(spark))


def label_language(label: str | None, names: dict[str, str]) -> str | None:
    """Code of the language that a label means, None if it means none. A region behind it doesn't count."""
    whole = (label or "").strip().lower()
    return names.get(whole) or names.get(re.split(r"[-_ (.@]", whole)[0])


def _longest_word(sentence: str) -> str:
    return max(sentence.split(" "), key=lambda w: (len(w), w))


def _scrambled(sentence: str, draw: np.random.Generator) -> str:
    """A sentence with the letters of all its words in another order."""
    codes = np.frombuffer(sentence.encode("utf-32-le"), dtype=np.uint32).copy()
    letters = codes != 32
    codes[letters] = draw.permutation(codes[letters])
    return codes.tobytes().decode("utf-32-le")


def _logistic(x: np.ndarray, y: np.ndarray, group: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression, each group of rows with the same total weight."""
    w = np.zeros(x.shape[1])
    each = len(y) / np.bincount(group)[group] / len(np.unique(group))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (each * (p - y)) + ridge * w
        hessian = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Detector:
    """Models and calibrated confidence, fitted on sentences by language.

    Every held_out-th sentence, by a hash of its longest word, so that variants of a sentence stay together,
    is kept from a second set of models, and their confidence in these sentences is calibrated: which
    language, by the temperature of least log loss; whether any, by a logistic regression on cross
    entropy and length, against names and scrambled sentences.
    """

    def __init__(self, own: dict[str, list[str]], names: list[str] = (), calibrate: bool = True, held_out: int = 5, seed: int = 1):
        own = {lang: sorted(set(ts)) for lang, ts in own.items() if ts}
        expand = lambda ts: list(dict.fromkeys(v for t in ts for v in spellings(t)))
        self.models = CharModels({lang: expand(ts) for lang, ts in own.items()})
        self.accuracy, self.new_accuracy = 0.0, 0.0
        self.power, self.heat, self.known = 1.0, 1.0, np.zeros(0)
        if not calibrate:
            return
        fold = {t: zlib.crc32(_longest_word(t).encode()) % held_out for ts in own.values() for t in ts}
        held = [(lang, t) for lang, ts in own.items() for t in ts if fold[t] == 0]
        rest = {lang: [t for t in ts if fold[t]] for lang, ts in own.items()}
        if not held or not all(rest.values()):
            return
        m = CharModels({lang: expand(ts) for lang, ts in rest.items()})
        texts = [t for _, t in held]
        total = -m.scores(texts)
        truth = np.array([m.codes.index(lang) for lang, _ in held])
        right = total.argmin(1) == truth
        self.accuracy = float(right.mean())
        triples = {t for ts in rest.values() for s in ts for t in zip(*(s.split(" ")[i:] for i in range(3)))}
        new = np.array([not any(t in triples for t in zip(*(s.split(" ")[i:] for i in range(3)))) for s in texts])
        self.new_accuracy = float(right[new].mean()) if new.any() else self.accuracy
        length = np.array([len(t) + 1 for t in texts])
        best = np.inf
        for power in (0.0, 0.25, 0.5, 0.75, 1.0):
            above = (total - total.min(1, keepdims=True)) / length[:, None] ** (1 - power)
            for heat in np.geomspace(0.01, 100, 41):
                loss = float((heat * above[np.arange(len(truth)), truth] + np.log(np.exp(-heat * above).sum(1))).mean())
                if loss < best:
                    best, self.power, self.heat = loss, power, float(heat)
        draw = np.random.default_rng(seed)
        against = [_scrambled(t, draw) for t in texts] + [_scrambled(_longest_word(t), draw) for t in texts] + list(names)
        lowest = np.concatenate([total.min(1), (-m.scores(against)).min(1)])
        length = np.concatenate([length, [len(t) + 1 for t in against]])
        group = np.concatenate([new.astype(int), np.repeat([2, 3], len(texts)), np.full(len(names), 4)])
        self.known = _logistic(self._features(lowest / length, length), group < 2, group)

    @staticmethod
    def _features(cost: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(cost)), cost, np.log(length)], axis=1)

    @classmethod
    def of_samples(cls, samples: list[tuple[str, str]], posts: list[tuple[str, str | None]] = (), names: list[str] = (), rounds: int = 2) -> "Detector":
        """Fitted on samples (lang, text), then on sentences of posts (text, language of the label) as well.

        The samples lack many words of the posts. A post is learnt from if its label is the language most
        of its words are found to be in, a sentence of it if it or the rest of its block is found to be in
        that language; further any sentence that stands in three posts or more, nearly all of one label.
        """
        own: dict[str, list[str]] = {}
        for (lang, _), ss in zip(samples, sentences_of_all([t for _, t in samples])):
            own.setdefault(lang, []).append(" ".join(ss))
        base = {lang: [t for t in ts if t] for lang, ts in own.items()}
        names = sorted({normal(n) for n in names} - {""})
        rounds = rounds if posts else 0
        blocks = [blocks_of(text or "") for text, _ in posts]
        found = iter(sentences_of_all([b for bs in blocks for b in bs]))
        read = [([[s for s in next(found) if s.count(" ") >= 2] for _ in bs], lang) for bs, (_, lang) in zip(blocks, posts)]
        detector = cls(base, names, calibrate=not rounds)
        for k in range(rounds):
            # a part of the posts is enough to begin with
            more = detector._learnt(read if k == rounds - 1 else read[: max(1000, len(read) // 4)])
            detector = cls({lang: ts + more.get(lang, []) for lang, ts in base.items()}, names, calibrate=k == rounds - 1)
        return detector

    def dumps(self) -> bytes:
        return pickle.dumps(self)

    @staticmethod
    def loads(raw: bytes) -> "Detector":
        """A detector stored by dumps(). Only for bytes that this program wrote."""
        return pickle.loads(raw)

    def _learnt(self, posts: list[tuple[list[list[str]], str]]) -> dict[str, list[str]]:
        """Sentences by language. posts: (blocks of sentences, language of the label)."""
        found: dict[str, set[str]] = {lang: set() for lang in self.models.codes}
        labels: dict[str, Counter] = {}
        distinct = sorted({s for blocks, _ in posts for block in blocks for s in block})
        best = dict(zip(distinct, [self.models.codes[j] for j in self.models.scores(distinct).argmax(1)])) if distinct else {}
        words = {s: s.count(" ") + 1 for s in distinct}
        for blocks, lang in posts:
            if lang not in found:
                continue
            for s in {s for block in blocks for s in block}:
                labels.setdefault(s, Counter())[lang] += 1
            own = [sum(words[s] for s in block if best[s] == lang) for block in blocks]
            every = [sum(words[s] for s in block) for block in blocks]
            if sum(own) <= 0.6 * sum(every):
                continue
            for block, o, e in zip(blocks, own, every):
                for s in block:
                    rest_own, rest = o - words[s] * (best[s] == lang), e - words[s]
                    if best[s] == lang or rest_own > 0.6 * max(1, rest):
                        found[lang].add(s)
        for s, by in labels.items():
            (lang, n), total = by.most_common(1)[0], sum(by.values())
            if total >= 3 and n >= 0.8 * total:
                for other in found.values():
                    other.discard(s)
                found[lang].add(s)
        return {lang: sorted(ss) for lang, ss in found.items()}

    def judge(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index or -1, cross entropy per character, calibrated confidence) of each sentence.

        confidence: chance that the sentence is in a language times the chance that it is this one.
        """
        if not sentences:
            return np.zeros(0, int), np.zeros(0), np.zeros(0)
        length = np.array([len(t) + 1 for t in sentences])
        total = -self.models.scores(sentences)
        best = total.argmin(1)
        low = total[np.arange(len(best)), best]
        sure = 1 / np.exp(-self.heat * (total - low[:, None]) / length[:, None] ** (1 - self.power)).sum(1)
        if len(self.known):
            sure = sure / (1 + np.exp(-np.clip(self._features(low / length, length) @ self.known, -30, 30)))
        return np.where(sure >= 0.5, best, -1), low / length, sure


def _votes(texts: list[str | None], detector: Detector) -> tuple[np.ndarray, ...]:
    """(post, block number, language index, confidence, words) of the blocks with a language, and, with
    number 0, of the posts with one, by post and number. post: index in texts."""
    blocks = [blocks_of(t) if t else [] for t in texts]
    sentences = sentences_of_all([b for bs in blocks for b in bs])
    flat = [s for ss in sentences for s in ss]
    once = {s: i for i, s in enumerate(dict.fromkeys(flat))}
    which, _, sure = detector.judge(list(once))
    at = np.array([once[s] for s in flat], dtype=np.int64)
    words = np.array([s.count(" ") + 1 for s in once], dtype=np.int64)
    n_langs, n_blocks = len(detector.models.codes), len(sentences)
    of_block = np.repeat(np.arange(n_blocks), [len(ss) for ss in sentences])
    lang = which[at] if len(at) else at
    has = lang >= 0
    cell, n = (of_block * n_langs + lang)[has], (words[at] if len(at) else at)[has]
    size = n_blocks * n_langs
    count = np.bincount(cell, weights=n, minlength=size)[:size].reshape(n_blocks, n_langs)
    weight = np.bincount(cell, weights=n * (sure[at] if len(at) else at)[has], minlength=size)[:size].reshape(n_blocks, n_langs)
    per_post = np.array([len(bs) for bs in blocks], dtype=np.int64)
    post = np.repeat(np.arange(len(texts)), per_post)
    number = np.arange(n_blocks) - np.repeat(np.cumsum(per_post) - per_post, per_post) + 1
    sums = [np.zeros((len(texts), n_langs)) for _ in range(2)]
    for s, x in zip(sums, (count, weight)):
        np.add.at(s, post, x)
    post, number = np.concatenate([post, np.arange(len(texts))]), np.concatenate([number, np.zeros(len(texts), np.int64)])
    count, weight = np.concatenate([count, sums[0]]), np.concatenate([weight, sums[1]])
    some = np.flatnonzero(count.any(1))
    some = some[np.lexsort((number[some], post[some]))]
    count, weight = count[some], weight[some]
    # most words, then most confidence, then the first code
    lang = np.where(count == count.max(1, keepdims=True), weight, -1.0).argmax(1) if len(some) else np.zeros(0, np.int64)
    row = np.arange(len(some))
    return post[some], number[some], lang, weight[row, lang] / count.sum(1), count[row, lang].astype(np.int64)


def _slices(texts: list[str | None]):
    """Ranges of texts with about AT_ONCE characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


SCHEMA = "doc_id long, block_no int, lang string, confidence double, words int"


def fitted(documents: DataFrame, samples: DataFrame, max_samples: int = MAX_SAMPLES, max_posts: int = MAX_POSTS, max_characters: int = MAX_POST_CHARACTERS, max_names: int = MAX_NAMES) -> Detector:
    """Detector from at most max_samples sentences, max_posts labelled posts of max_characters together and
    max_names names of authors, if documents has the column author; each the first by hash."""
    spellings_of = label_languages(documents.sparkSession)
    rows = samples.where("lang is not null and text is not null").select("lang", "text").distinct()
    sentences = [(r.lang, r.text) for r in rows.orderBy(F.xxhash64("text"), "text", "lang").limit(max_samples).collect()]
    posts = documents.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    names: list[str] = []
    # drawn by hash before the sort, so that tasks don't each send the driver as many rows as are wanted
    n = max(1, posts.count())
    drawn = lambda of, most: F.pmod(F.xxhash64(of), F.lit(1_000_000)) < F.lit(min(1_000_000, -(-1_200_000 * most // n)))
    if "author" in documents.columns:
        one = documents.where("author is not null").select("author").distinct()
        names = [r.author for r in one.orderBy(F.xxhash64("author"), "author").limit(max_names).collect()]
    sizes = posts.where(drawn("doc_id", max_posts)).select("doc_id", "text", "lang", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_posts)
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = sizes.withColumn("_sum", before).where(F.col("_sum") <= max_characters).select("text", "lang").collect()
    return Detector.of_samples(sentences, [(r.text, label_language(r.lang, spellings_of)) for r in taken], names)


def detect_languages(documents: DataFrame, samples: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Rows (doc_id, block_no, lang, confidence, words): block 0 is the post as a whole.

    Posts and blocks without a language (null, empty, code, links, names only) have no row. No shuffle;
    whole texts are read. doc_ids may repeat; each row is judged on its own. detector: one fitted before.
    """
    shared = documents.sparkSession.sparkContext.broadcast(detector or fitted(documents, samples))

    def run(batches):
        d = shared.value
        codes = pa.array(d.models.codes, pa.string())
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _slices(texts):
                post, number, lang, sure, words = _votes(texts[lo:hi], d)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).take(pa.array(post + lo)), "block_no": pa.array(number, pa.int32()), "lang": codes.take(pa.array(lang)), "confidence": pa.array(sure), "words": pa.array(words, pa.int32())})

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, SCHEMA)


def label_faults(documents: DataFrame, samples: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(doc_id, block_no, lang): block 0 for posts whose label is missing, unknown or another language's;
    from 1 the blocks of posts with blocks of two or more languages. doc_id must be unique."""
    spellings_of = label_languages(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(detector or fitted(documents, samples))

    def run(batches):
        d = shared.value
        codes = pa.array(d.models.codes, pa.string())
        index = {c: i for i, c in enumerate(d.models.codes)}
        means: dict[str | None, int] = {}
        for b in batches:
            texts, labels = b.column(1).to_pylist(), b.column(2).to_pylist()
            for label in {*labels} - means.keys():
                means[label] = index.get(label_language(label, spellings_of), -1)
            said = np.array([means[x] for x in labels], dtype=np.int64)
            for lo, hi in _slices(texts):
                post, number, lang, _, _ = _votes(texts[lo:hi], d)
                inner = number > 0
                low, high = np.full(hi - lo, len(index)), np.full(hi - lo, -1)
                np.minimum.at(low, post[inner], lang[inner])
                np.maximum.at(high, post[inner], lang[inner])
                keep = np.flatnonzero(np.where(inner, low[post] < high[post], said[post + lo] != lang))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).take(pa.array(post[keep] + lo)), "block_no": pa.array(number[keep], pa.int32()), "lang": codes.take(pa.array(lang[keep]))})

    return documents.where("text is not null").select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, block_no int, lang string")
