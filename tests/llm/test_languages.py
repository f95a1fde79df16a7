import math
import random
import time

import numpy as np
import pytest

from stemma.llm.kneser_ney import CharModels
from stemma.llm.languages import Detector, blocks_of, detect_languages, label_faults, fitted, label_language, label_languages, plain, sentences_of, spellings

FOLDER = "/root/testdata/sf0.01"


def test_model_against_plain_formula():
    """Probabilities of a tiny corpus, order 3, by the textbook recursion."""
    texts = ["abab", "abc", "b"]
    m = CharModels({"x": texts, "y": ["zzz"]}, order=3, discount=0.5)
    padded = [f" {t} " for t in texts]
    grams = [{} for _ in range(4)]
    for n in (1, 2, 3):
        for t in padded:
            for i in range(len(t) - n + 1):
                grams[n][t[i : i + n]] = grams[n].get(t[i : i + n], 0) + 1
    count = {3: grams[3]}
    for n in (1, 2):
        count[n] = {g: max(1, len({h for h in grams[n + 1] if h[1:] == g})) for g in grams[n]}

    def p(n, g):
        if n == 0:
            return m.uniform
        same = {h: c for h, c in count[n].items() if h[:-1] == g[:-1]}
        if not same:
            return p(n - 1, g[1:])
        total = sum(same.values())
        return max(same.get(g, 0) - 0.5, 0) / total + 0.5 * len(same) / total * p(n - 1, g[1:])

    for text in ("abab", "abcb", "bbb", "a"):
        t = f" {text} "
        want = sum(math.log(p(min(3, i + 1), t[max(0, i - 2) : i + 1])) for i in range(1, len(t)))
        assert m.scores([text])[0, 0] == pytest.approx(want, rel=1e-4)
    assert sum(math.exp(math.log(p(3, "ab" + ch))) for ch in {*"abcz "}) == pytest.approx(1, abs=0.2)


def test_scores_do_not_depend_on_neighbours():
    m = CharModels({"x": ["hello world", "held"], "y": ["dag allemaal"]})
    texts = ["hello", "x", "dag", "", "qqq", "hello world held"]
    together = m.scores(texts)
    assert np.allclose(together, np.vstack([m.scores([t]) for t in texts])) and np.allclose(together, m.scores(texts, block=3))


def test_blocks_and_sentences():
    text = "One two.\r\nThree\r\n \t\r\n```\ncode\n\nmore code\n```\n\n[quote=\"x9\"]> Bonjour à&nbsp;tous &amp;amp; merci (name 4.2).[/quote]\n-- \nname\nWhole sentence here http://a.b/c."
    b = blocks_of(text)
    assert [x.replace("\x01", "") for x in b] == ["One two.\nThree", "\n", "\n", '[quote="x9"]> Bonjour à&nbsp;tous &amp;amp; merci (name 4.2).[/quote]\n-- \nname\nWhole sentence here http://a.b/c.']
    assert sentences_of(b[3]) == ["bonjour à tous merci", "whole sentence here"]
    for nothing in ("http://x.y/z?a=1", "!!! 1.000 ½ ² ③", "[deleted]", "-- \nabc | Def #12", "2021-01-01 10:00, abc wrote:", "[img]http://a/b.png[/img]", "", "   "):
        assert sentences_of(nothing) == []


def test_labels(spark):
    names = label_languages(spark)
    told = [label_language(x, names) for x in ("EN", "en-US", "en_GB", "English", "eng", "ger", "German", "", None, "und", "xx", "??", "N/A", "unknown")]
    assert told == ["en"] * 5 + ["de"] * 2 + [None] * 7
    assert [label_language(x, names) for x in ("cs", "Danish", "ukr", "zh-Hant-TW", "chi", "Portuguese (Brazil)")] == ["cs", "da", "uk", "zh", "zh", "pt"]


def test_spellings():
    assert plain("żółw çà straße ё") == "zolw ca strasse е" and "schyot" in spellings("щёт")


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/lang_samples.parquet")


def test_held_out_accuracy(data):
    samples = [(r.lang, r.text) for r in data[1].collect()]
    random.Random(1).shuffle(samples)
    train, held = samples[:200], samples[200:]
    d = Detector.of_samples(train)
    sentences = [" ".join(sentences_of(t)) for _, t in held]
    which, _, _ = d.judge(sentences)
    right = sum(d.models.codes[w] == lang for w, (lang, _) in zip(which, held) if w >= 0)
    assert right >= 0.97 * len(held)
    assert Detector.of_samples(samples).accuracy >= 0.97
    names = ["venrok", "tulmir", "zanhep", "qwxz", "rokshagru"]
    assert (Detector.of_samples(samples, [(r.text, r.lang) for r in data[0].where("text is not null").collect()]).judge(names)[0] == -1).all()


def test_every_letter_counts():
    """More letters than a byte can name: none of them is an unknown one."""
    letters = [chr(0x4E00 + i) for i in range(3000)]
    m = CharModels({"zh": ["".join(letters)], "en": ["some words in latin letters"]})
    runs = ["".join(letters[i : i + 4]) for i in range(0, 3000, 4)]
    assert (m.scores(runs).argmax(1) == m.codes.index("zh")).all()


def test_long_lines_and_words():
    """Time grows with the length, not with its square."""
    for unit in ("x", ">", "(1", "a@", "[", "<", "--", "1:", "https://", "``", "_", "("):
        began = time.time()
        sentences_of(unit * 200_000)
        blocks_of(unit * 200_000)
        assert time.time() - began < 5, unit


def test_calibration(data):
    """Confidence as a share of right answers, on sentences whose words none of the fitted ones has in a row."""
    samples = [(r.lang, r.text) for r in data[1].collect()]
    random.Random(2).shuffle(samples)
    d = Detector.of_samples(samples[:200], names=[r.author for r in data[0].where("author is not null").select("author").distinct().collect()])
    truth = [lang for lang, _ in samples[200:]]
    which, _, sure = d.judge([" ".join(sentences_of(t)) for _, t in samples[200:]])
    right = np.array([d.models.codes[w] == lang if w >= 0 else False for w, lang in zip(which, truth)])
    assert right.mean() >= 0.9 and abs(right.mean() - sure.mean()) < 0.2 and 0 < d.new_accuracy <= 1
    assert (Detector.loads(d.dumps()).judge(["hello there my friend"])[2] == d.judge(["hello there my friend"])[2]).all()


def test_a_language_more(spark, data):
    """A language that the samples gain is found, and its right labels are right."""
    docs, samples = data
    danish = ["jeg har ikke set filen endnu men den skulle være på serveren", "hvad mener du med at mappen er tom", "det virker ikke hos os efter den seneste opdatering", "kan nogen hjælpe mig med at finde den gamle udgave", "vi sletter billederne hvis ingen bruger dem længere"]
    more = samples.select("lang", "text").unionByName(spark.createDataFrame([("da", t) for t in danish], "lang string, text string"))
    own = spark.createDataFrame([(1, ". ".join(danish), "dan"), (2, ". ".join(danish), "sv")], "doc_id long, text string, lang string")
    got = label_faults(own, more, fitted(docs.unionByName(own, allowMissingColumns=True), more, max_posts=500)).collect()
    assert [(r.doc_id, r.block_no, r.lang) for r in got] == [(2, 0, "da")]


def test_posts(spark, data):
    docs, samples = data
    en = "The old server lost the final list. My colleague found every texture after the weekend."
    sv = "Den gamla servern raderade alla förhandsvisningar utan något meddelande."
    rows = [(1, en, "en"), (2, en, "de"), (3, sv, None), (4, en + "\n\n" + sv, "EN-gb"), (5, None, "en"), (6, "", None), (7, "http://a.b/c\n\n12 34", "xx"), (8, (en + " ") * 3000, "English"), (9, plain(sv), "sv"), (10, en.upper(), "und")]
    own = spark.createDataFrame([(i, t, lang, "c") for i, t, lang in rows], "doc_id long, text string, lang string, block_no string")
    both = own.unionByName(docs.select((docs.doc_id + 1000).alias("doc_id"), "text", "lang"), allowMissingColumns=True)
    got = {(r.doc_id, r.block_no): r.lang for r in label_faults(both, samples).where("doc_id < 1000").collect()}
    assert got == {(2, 0): "en", (3, 0): "sv", (4, 1): "en", (4, 2): "sv", (10, 0): "en"} | ({(4, 0): "en"} if (4, 0) in got else {})
    assert (4, 0) not in got
    languages = {(r.doc_id, r.block_no): r for r in detect_languages(both, samples).where("doc_id < 1000").collect()}
    assert languages[4, 0].lang == "en" and languages[8, 0].words == 45_000 and all(0 < r.confidence <= 1 for r in languages.values())
    assert not {5, 6, 7} & {i for i, _ in languages}
    assert label_faults(own.limit(0), samples).count() == 0
