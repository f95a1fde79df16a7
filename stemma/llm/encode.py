"""Token ids of whole texts by a public byte-level BPE, encoding shared chunks once.

A rolling hash over the last bytes chooses where texts are cut, so equal passages give equal chunks
wherever they stand; each distinct chunk among the documents a task holds at a time is encoded once, and
texts are put together from the chunks' ids. A join is repaired where the ids on its sides would
not be those of the whole text: both sides are then encoded as one. That is so wherever a mark is not
before a blank that follows a character other than white space; such a blank always begins a piece
of the tokenizer's splitting pattern, whatever stands around it, and no piece reaches across. So the
result equals encoding each text at once.

Chunks aren't exchanged between tasks: sending a chunk through a shuffle and its ids through a join
costs more than encoding it. What tasks share, they share through their own documents.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A mark at one of 2**CUT_BITS words, decided by the last WINDOW bytes before it.
CUT_BITS, WINDOW = 1, 8
#: Bytes of text whose chunks a task compares at a time.
AT_ONCE = 32 << 20
_G, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def vocabulary(folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The rank file, read once on the driver and sent to the tasks."""
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


class Encoder:
    """A vocabulary's encoding of single texts, and of many chunks in one call."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        tokens = {base64.b64decode(a): int(b) for a, b in pairs}
        self.text = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={}).encode_ordinary
        self.size = np.zeros(max(tokens.values()) + 1, dtype=np.int64)  # bytes of each token
        for token, i in tokens.items():
            self.size[i] = len(token)

    def chunks(self, chunks: list[str], at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, and how many each has.

        Chunks that begin with a blank and end with another character are encoded together: no token
        reaches across, so the tokens' sizes tell where each chunk ends.
        """
        inner = [i for i, s in enumerate(chunks) if s[0] in " \n" and not s[-1].isspace()]
        alone = sorted(set(range(len(chunks))).difference(inner))
        counts = np.zeros(len(chunks), dtype=np.int64)
        parts, order = [], []
        for lo, hi in _runs([len(chunks[i]) for i in inner], at_once):
            some = inner[lo:hi]
            ids = np.array(self.text("".join(chunks[i] for i in some)), dtype=np.int32)
            ends = np.cumsum([len(chunks[i].encode()) for i in some])
            counts[some] = np.diff(np.searchsorted(np.cumsum(self.size[ids]), ends, side="right"), prepend=0)
            parts.append(ids)
            order += some
        for i in alone:
            parts.append(np.array(self.text(chunks[i]), dtype=np.int32))
            counts[i] = len(parts[-1])
        order = np.array(order + alone, dtype=np.int64)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        # back into the chunks' own order
        sizes = counts[order]
        begins = np.zeros(len(chunks), dtype=np.int64)
        begins[order] = np.cumsum(sizes) - sizes
        return flat[_spread(begins, counts)], counts


def _runs(sizes: list[int], at_once: int) -> Iterator[tuple[int, int]]:
    """Ranges whose sizes sum up to about at_once."""
    which = np.cumsum(sizes) // at_once if sizes else np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(which)) + 1
    yield from zip([0, *cut.tolist()], [*cut.tolist(), len(sizes)]) if sizes else ()


def _spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of each range, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - counts), counts)


@functools.lru_cache(maxsize=4)
def encoding(ranks: bytes) -> Encoder:
    return Encoder(ranks)


def _after_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place of UTF-8 bytes is white space. Places are 1 or more."""
    a = raw[at - 1]
    out = (a == 32) | ((a >= 9) & (a <= 13)) | ((a >= 28) & (a <= 31))
    wide = np.flatnonzero(a >= 128)
    if len(wide):
        p = at[wide]
        last, mid, first = a[wide], raw[p - 2], raw[np.maximum(p - 3, 0)]
        two = (mid == 0xC2) & ((last == 0x85) | (last == 0xA0))
        general = (first == 0xE2) & (mid == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
        others = ((first == 0xE2) & (mid == 0x81) & (last == 0x9F)) | ((first == 0xE1) & (mid == 0x9A) & (last == 0x80)) | ((first == 0xE3) & (mid == 0x80) & (last == 0x80))
        out[wide] = two | general | others
    return out


def cuts(raw: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Places in UTF-8 bytes at which chunks begin, without the first and the last one."""
    blank = np.flatnonzero((raw == 32) | (raw == 10))
    blank = blank[blank >= WINDOW]
    h = np.zeros(len(blank), dtype=np.uint64)
    for j in range(1, WINDOW + 1):
        h = h * _G + raw[blank - j]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    marked = blank[(h >> np.uint64(64 - bits)) == 0] if bits else blank
    return marked[~_after_space(raw, marked)]


def chunked(texts: pa.Array, bits: int = CUT_BITS) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of all texts in order, as a dictionary, and how many each text has. Texts have no nulls;
    an empty one has no chunks."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[: offsets[-1]]
    inside = cuts(raw, bits)
    own = offsets[:-1][np.diff(offsets) > 0]
    own = own[~np.isin(own, inside, assume_unique=True)]
    starts = np.insert(inside, np.searchsorted(inside, own), own)
    ends = np.append(starts, offsets[-1])
    # the same bytes, divided at the cuts
    chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), texts.buffers()[2] or pa.py_buffer(b""))
    return chunks.dictionary_encode(), np.diff(np.searchsorted(starts, offsets))


def _windows(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts have AT_ONCE bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(text).nbytes
        if size >= AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _encoded(texts: pa.ChunkedArray, encoder: Encoder, lengths_only: bool = False) -> pa.Array:
    """Ids of each text, or their number. Null texts count as empty."""
    one = pa.concat_arrays([c.fill_null("") for c in texts.chunks] or [pa.array([], pa.string())])
    chunks, per_text = chunked(one)
    flat, sizes = encoder.chunks(chunks.dictionary.to_pylist())
    at = chunks.indices.to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes[at])]).astype(np.int64)
    bounds = ends[np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)]
    if lengths_only:
        return pa.array(np.diff(bounds), pa.int64())
    ids = flat[_spread((np.cumsum(sizes) - sizes)[at], sizes[at])]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def encode_documents(documents: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids) of every row; null and empty texts have no ids: []. Repeated doc_ids each have a row.

    Other columns are ignored. No shuffle; a task holds the texts of AT_ONCE bytes, or one longer text.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(vocabulary(folder))

    def run(batches):
        encoder = encoding(ranks.value)
        for t in _windows(batches, 1):
            ids = _encoded(t.column(1), encoder)
            for lo in range(0, len(ids), 1000):  # ids take as much room as the texts or more
                yield pa.RecordBatch.from_pydict({"doc_id": t.column(0).slice(lo, 1000).combine_chunks(), "ids": ids.slice(lo, 1000)})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """documents' doc_id and source with n_tokens, 0 for null and empty texts."""
    ranks = documents.sparkSession.sparkContext.broadcast(vocabulary(folder))

    def run(batches):
        encoder = encoding(ranks.value)
        for t in _windows(batches, 2):
            counts = _encoded(t.column(2), encoder, lengths_only=True)
            yield from pa.table({"doc_id": t.column(0), "source": t.column(1), "n_tokens": counts}).to_batches()

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long")
