"""Fill-in-the-middle texts: two cuts at token ends, found by summaries of content-defined chunks that are kept and shared.

A rolling hash over 32 bytes cuts a text into chunks where its ten highest bits are zero, so equal passages give equal chunks
in all documents. A chunk's summary is what other chunks need to know of it: its words, its code points, and whether it
begins and ends inside a word. Summaries are kept by the chunk's whole content, so a chunk that comes again (copies, shared
passages, boilerplate) is compared byte by byte and not counted again. The sum of a document's summaries, less the words that
run over a chunk's end, gives its tokens and the two chunks that hold its cuts; only those are looked at again.

A token is a run of word characters with the white space before it; white space at the end of a text is a token of its own.

Null text is the empty text and stays plain. A null doc_id draws its numbers from the seed and an empty id. Rows that repeat
are handled each for itself. A text of any length is cut as a whole; the arrays of its hashes are made 1 MB at a time, chunks
have 256 to 8,192 bytes, and the kept summaries are bounded by the bytes of their chunks. A text that holds one of the three
marks stays plain, so marks in an output are its own. Other columns of the input are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

#: Bytes a hash sees, bits of it that are zero at a cut, and the least and most bytes of a chunk.
WINDOW, ZEROS, LEAST, MOST = 32, 10, 256, 8192
#: Bytes hashed at once, bytes that a task keeps in each of its two generations of chunks, and bytes an entry takes besides.
SLICE, KEPT, ENTRY = 1 << 20, 32 << 20, 300
#: Documents or bytes of text in a batch of results.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20

_SPACE = frozenset(b" \t\n\v\f\r")
_CONTINUATION = bytes(range(0x80, 0xC0))
_GEAR = np.random.default_rng(2).integers(0, 1 << 32, 256, dtype=np.uint32)

MADE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of chunks by content alone: places after a window whose hash begins with ``ZEROS`` zeros."""
    found = []
    for at in range(0, len(data), SLICE):
        begin = max(at - WINDOW + 1, 0)
        h = _GEAR[data[begin : at + SLICE]]
        step = 1
        while step < WINDOW:  # each turn doubles the bytes that a hash has seen
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        ends = np.flatnonzero(h >> np.uint32(32 - ZEROS) == 0) + begin + 1
        found.append(ends[(ends > at) & (ends >= WINDOW)])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunks(begin: int, end: int, cuts: list[int]) -> list[int]:
    """Ends of the chunks of the text between ``begin`` and ``end``."""
    ends, k = [], 0
    while begin < end:
        k = bisect_left(cuts, begin + LEAST, k)
        begin = min(cuts[k] if k < len(cuts) else end, begin + MOST, end)
        ends.append(begin)
    return ends


class Summaries:
    """(words, code points, begins in a word, ends in a word) of chunks, kept by content in two generations."""

    def __init__(self, kept: int = KEPT):
        self.kept, self.size, self.young, self.old, self.made = kept, 0, {}, {}, 0

    def of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                self.made += 1
                chars = len(chunk.translate(None, _CONTINUATION))
                found = (len(chunk.split()), chars, chunk[0] not in _SPACE, chunk[-1] not in _SPACE)
            if self.size > self.kept:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[chunk] = found
            self.size += len(chunk) + ENTRY
        return found


class Counted:
    """One text as its chunks' summaries put together."""

    def __init__(self, text: bytes, ends: list[int], summaries: Summaries):
        self.text, self.ends = text, ends
        self.begins = [0, *ends[:-1]]
        self.parts = [summaries.of(text[a:b]) for a, b in zip(self.begins, ends)]
        self.upto: list[int] = []  # words begun up to the end of each chunk
        words, inside = 0, False
        for count, _, opens, closes in self.parts:
            words += count - (inside and opens)
            self.upto.append(words)
            inside = closes
        self.words = words
        self.tokens = words + (bool(text) and not inside)

    def end_of(self, k: int) -> tuple[int, int]:
        """Byte and code point where the first ``k`` tokens end."""
        if k == 0:
            return 0, 0
        if k > self.words:
            at = len(self.text)
            return at, sum(p[1] for p in self.parts)
        i = bisect_left(self.upto, k)
        before = self.upto[i - 1] if i else 0
        runs_on = i > 0 and self.parts[i - 1][3] and self.parts[i][2]
        at = self._word_end(i, k - before + runs_on)
        while at == self.ends[i] and i + 1 < len(self.ends) and self.parts[i + 1][2]:
            i += 1
            at = self._word_end(i, 1)
        chars = sum(p[1] for p in self.parts[:i])
        return at, chars + len(self.text[self.begins[i] : at].translate(None, _CONTINUATION))

    def _word_end(self, i: int, k: int) -> int:
        """Where the ``k``-th word of chunk ``i`` ends in it, counted from 1."""
        chunk = np.frombuffer(self.text[self.begins[i] : self.ends[i]], np.uint8)
        word = (chunk != 0x20) & ((chunk < 0x09) | (chunk > 0x0D))
        last = np.flatnonzero(word & ~np.append(word[1:], False))
        return self.begins[i] + int(last[k - 1]) + 1


def count_all(texts: list[bytes], summaries: Summaries) -> Iterator[Counted]:
    """Hashes many texts as one, so that short ones cost no array operation each."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    cuts = cut_points(data)
    begin = 0
    for text in texts:
        own = cuts[np.searchsorted(cuts, begin + WINDOW) : np.searchsorted(cuts, begin + len(text))] - begin
        yield Counted(text, chunks(0, len(text), own.tolist()), summaries)
        begin += len(text)


def arranged(doc_id: int | None, text: bytes, counted: Counted, seed: int, rate: int, spm_rate: int) -> tuple:
    """n, form, code points of prefix and middle, and the output."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = counted.tokens
    if not text or h[2] % 100 >= rate or any(mark in text for mark in _MARKS):
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, a_chars), (b, b_chars) = counted.end_of(first), counted.end_of(second)
    p, s, m = _MARKS
    if h[3] % 100 < spm_rate:
        form, output = "spm", b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    else:
        form, output = "psm", b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return n, form, a_chars, b_chars - a_chars, output


def fill_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """doc_id, n tokens, form (plain, psm, spm), code points of prefix and middle (null if plain) and the output text.

    Per document of ``docs`` (doc_id, text): ``rate`` in 100 are rearranged, of these ``spm_rate`` in 100 with the suffix
    first. No shuffle; every number comes from the seed and doc_id, so a lost task gives the same rows again.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = Summaries()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())
            begin = 0
            while begin < len(ids):
                some: list[bytes] = []
                held = 0
                while begin + len(some) < len(ids) and len(some) < BATCH_ROWS and held < BATCH_BYTES:
                    some.append(texts[begin + len(some)].as_py() or b"")
                    held += len(some[-1])
                rows = [
                    (doc_id, *arranged(doc_id, text, counted, seed, rate, spm_rate))
                    for doc_id, text, counted in zip(ids[begin:], some, count_all(some, summaries))
                ]
                begin += len(some)
                columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), _KINDS)]
                yield pa.record_batch(columns, MADE.names)

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(make, MADE)


def restore(output: Column | str, form: Column | str) -> Column:
    """The text again, from an output and its form alone."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def part(of: Column, mark: str, k: int) -> Column:
        return F.split_part(of, F.lit(mark), F.lit(k))

    def after_mark(of: Column) -> Column:
        return F.substr(of, F.lit(len(PREFIX) + 1))

    middle = part(output, MIDDLE, 2)
    psm = F.concat(after_mark(part(output, SUFFIX, 1)), middle, part(part(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), middle, after_mark(part(output, PREFIX, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
