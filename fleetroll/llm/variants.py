"""Spelling variants: words one edit apart, from blocked Gram matrices of their letter counts.

A word's letter counts are a vector. One inserted or deleted letter moves it by a squared distance of 1, one replaced letter
by 2, so near words have squared distances of 1 or 2, and a block's distances all come from one NumPy product of its count
matrices: |a - b|^2 = a.a + b.b - 2 a.b. A block holds words of two adjacent lengths, L and L + 1: rows are the words of length
L, columns those of both lengths. Pairs within the bound are then verified letter by letter.

The vocabulary grows with the corpus, so a length is cut into blocks that lose no pair: one edit falls into one half of a
word and leaves the other half alone. Words that share all but one half, at the same place, are a block. Blocks of more than
``BLOCK`` words halve that half again, until a block is small enough or but one letter is free, which bounds it by the
alphabet. A pair is taken only by the block whose free part holds its edit, so once. Tasks give per word and block the number
of near words and the best of them, never pairs, and a sum over blocks makes the result.

Null text has no words. In a row without doc_id no run loses a letter. Repeated rows count each for itself. Texts of any length are read
in pieces of 1 MB cut at white space or another non-letter, words of any length are kept (products of few rows at a time).
Ties go to the smallest word in code-point order. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

#: Words are of at least these many code points and occurrences; a form has at least so many times a word's occurrences.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: One in so many runs loses a letter.
DAMAGED = 97
#: Words of a block before its free part is halved, and numbers in the matrices held at once.
BLOCK, CELLS = 1024, 4 << 20
#: Bytes of text split at once, and words whose counts a task holds.
PIECE, HELD = 1 << 20, 200_000

#: Latin-1 bytes to themselves if a letter, A-Z to a-z, all else to a space.
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256)
)
_RUN_END = re.compile(rb"\x20|\Z")
#: Place of each letter's count.
_PLACE = np.zeros(256, np.int64)
_PLACE[0x61:0x7B] = np.arange(26)
_PLACE[0xC0:] = np.arange(26, 90)
_KINDS = 90

COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
NEAR = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("n_near", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("form_n", T.LongType()),
    ]
)


def _pieces(text: str) -> Iterator[list[bytes]]:
    """The lower-cased letter runs of a text, a piece at a time."""
    at = 0
    while at < len(text):
        data = text[at : at + PIECE].encode("latin-1", "replace").translate(_LETTERS)
        at += PIECE
        while at < len(text) and data[-1] != 0x20:  # a run goes on
            more = text[at : at + PIECE].encode("latin-1", "replace").translate(_LETTERS)
            end = _RUN_END.search(more).end()
            data += more[:end]
            at += end
        yield data.split()


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def count_words(docs: DataFrame, damaged: int = DAMAGED, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n over ``docs`` (doc_id, text): lower-cased runs of letters, some less a letter by a hash of document and run."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array([_utf8(w) for w in held], pa.string()), pa.array(held.values(), pa.int64())]
            held.clear()
            return pa.record_batch(columns, COUNTS.names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                doc_id, text = doc_id.as_py(), text.as_py()
                begin = zlib.crc32(b"%d:" % doc_id) if doc_id is not None else None
                for runs in _pieces(text or ""):
                    for run, n in Counter(runs).items():
                        if len(run) < least_length:
                            continue  # losing a letter makes none longer
                        if begin is not None:
                            h = zlib.crc32(_utf8(run), begin)
                            if h % damaged == 0:
                                k = h % len(run)
                                run = run[:k] + run[k + 1 :]
                                if len(run) < least_length:
                                    continue
                        held[run] += n
                    if len(held) >= HELD:
                        yield flush()
        if held:
            yield flush()

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(count, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(words: DataFrame) -> DataFrame:
    """word, n, and its blocks: base (the smaller length), first to last (the base's free places), key (a hash of the rest)."""
    free = F.array(
        F.struct(F.lit(0).alias("first"), (F.col("base") / 2).cast("int").alias("last")),
        F.struct((F.col("base") / 2).cast("int").alias("first"), F.col("base").alias("last")),
    )
    size = F.char_length("word")
    both = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("base")).where(f"base >= {LEAST_LENGTH}")
    return _with_key(both.select("*", F.inline(free)))


def _with_key(rows: DataFrame) -> DataFrame:
    longer = F.char_length("word") - F.col("base")
    rest = (F.substr("word", F.lit(1), F.col("first")), F.substr("word", F.col("last") + longer + 1))
    return rows.withColumn("key", F.xxhash64("base", "first", "last", *rest))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.expr("int((first + last) / 2)")
    halves = F.array(
        F.struct(F.col("first"), middle.alias("last")), F.struct(middle.alias("first"), F.col("last"))
    )
    return _with_key(rows.select("word", "n", "base", F.inline(halves)))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """The rows of ``_keyed``, with large blocks cut into smaller ones; each turn writes the rows it cuts."""
    rows, done = saved(_keyed(words), "blocks"), None
    while True:
        large = rows.groupBy("key").count().where(F.col("count") > most)
        large = saved(large.select("key"), "large")
        can_halve = F.col("last") - F.col("first") > 1
        # At most a key per ``most`` rows.
        over = rows.where(can_halve).join(large, "key", "left_semi")
        small = rows.join(large, "key", "left_anti").unionByName(rows.where(~can_halve).join(large, "key", "left_semi"))
        done = small if done is None else done.unionByName(small)
        over = saved(_halved(over), "halved")
        if over.isEmpty():
            return done
        rows = over


class _Best:
    """Near words counted and the best of them, of the words of some blocks."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.from_, self.to = [], []

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        self.from_ += [a, b]
        self.to += [b, a]

    def batch(self) -> pa.RecordBatch | None:
        a, b = np.concatenate(self.from_), np.concatenate(self.to)
        if not len(a):
            return None
        names = pa.array(self.words, pa.string())
        # Order by word, then most occurrences, then the smaller word; UTF-8 bytes are in code-point order.
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(np.array([w.encode() for w in self.words], object), kind="stable")] = np.arange(len(names))
        order = np.lexsort((rank[b], -self.n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        count = np.diff(first, append=len(a))
        columns = [names.take(pa.array(a[first])), pa.array(count), names.take(pa.array(b[first])), pa.array(self.n[b[first]])]
        return pa.record_batch(columns, NEAR.names)


def _letters(words: list[str], width: int) -> np.ndarray:
    """Latin-1 codes of the words, a row each, zeros behind the end."""
    return np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each letter stands in each row."""
    rows = np.repeat(np.arange(len(codes)), codes.shape[1])
    at = (rows * _KINDS + _PLACE[codes.ravel()])[codes.ravel() > 0]
    kind = np.float32 if codes.shape[1] <= 4096 else np.float64  # whole numbers stay exact
    return np.bincount(at, minlength=len(codes) * _KINDS).reshape(-1, _KINDS).astype(kind)


def near_pairs(codes: np.ndarray, base: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of one block that are one edit apart with the edit in ``first`` to ``last``; a is of length ``base``.

    Words of equal length come as a < b. ``codes`` has base + 1 columns.
    """
    long = codes[:, base] > 0
    short = np.flatnonzero(~long)
    counts = letter_counts(codes)
    norms = (counts * counts).sum(1)
    found = []
    step = max(CELLS // max(len(codes), 1), 1)
    for k in range(0, len(short), step):
        rows = short[k : k + step]
        distance = norms[rows][:, None] + norms[None, :] - 2 * (counts[rows] @ counts.T)
        a, b = np.nonzero(distance <= 2)
        a = rows[a]
        ok = long[b] | (a < b)
        found.append(verified(codes, a[ok], b[ok], base, first, last))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def verified(codes, a, b, base: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with exactly one edit, whose place (the end of their common beginning) is free in this block."""
    kept_a, kept_b = [], []
    step = max(CELLS // (base + 1), 1)
    for k in range(0, len(a), step):
        x, y = codes[a[k : k + step]], codes[b[k : k + step]]
        same = x == y
        at = np.argmin(same, 1)  # first place that differs; x is 0 at ``base``, where a longer y differs at the latest
        longer = y[:, base] > 0
        places = np.arange(base)[None, :]
        replaced = (same[:, :base].sum(1) == base - 1) & ~longer
        behind = (x[:, :base] == y[:, 1:]) | (places < at[:, None])
        inserted = longer & behind.all(1)
        free = (at >= first) & ((at < last) | ((at == base) & (last == base)))
        ok = (replaced | inserted) & free
        kept_a.append(a[k : k + step][ok])
        kept_b.append(b[k : k + step][ok])
    if not kept_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(kept_a), np.concatenate(kept_b)


def _small_blocks(codes: np.ndarray, size: int, base: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """``near_pairs`` of many blocks of equal ``size``, whose rows follow each other, by one product of stacked matrices."""
    counts = letter_counts(codes).reshape(-1, size, _KINDS)
    norms = (counts * counts).sum(2)
    distance = norms[:, :, None] + norms[:, None, :] - 2 * (counts @ counts.transpose(0, 2, 1))
    block, a, b = np.nonzero(distance <= 2)
    a, b = block * size + a, block * size + b
    long = codes[:, base] > 0
    ok = ~long[a] & (long[b] | (a < b))
    return verified(codes, a[ok], b[ok], base, first, last)


def near_words(rows: DataFrame) -> DataFrame:
    """word, n_near, form and form_n (the near word that occurs most) for words that have near words."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, n, where, begins in _whole_blocks(batches):
            best = _Best(names, n)
            sizes = np.diff(begins, append=len(names))
            base = where[0][begins]
            # Blocks of one shape are compared together.
            shape = np.stack([base, where[1][begins], where[2][begins], sizes], 1)
            kinds, which = np.unique(shape, axis=0, return_inverse=True)
            for kind, (length, first, last, size) in enumerate(kinds.tolist()):
                if size < 2:
                    continue
                own = begins[which.ravel() == kind]
                at_once = max(CELLS // (size * max(size, _KINDS, length + 1)), 1) if size <= 64 else 1
                for k in range(0, len(own), at_once):
                    at = (own[k : k + at_once, None] + np.arange(size)[None, :]).ravel()
                    codes = _letters([names[i] for i in at], length + 1)
                    pair = near_pairs(codes, length, first, last) if size > 64 else _small_blocks(codes, size, length, first, last)
                    best.pairs(at[pair[0]], at[pair[1]])
            found = best.batch() if best.from_ else None
            if found is not None:
                yield found

    ordered = rows.repartition("key").sortWithinPartitions("key", "base", "first", "last", "word")
    parts = ordered.select("word", "n", "base", "first", "last", "key").mapInArrow(compare, NEAR)
    better = F.struct((-F.col("form_n")).alias("n"), "form")
    summed = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(better).alias("best"))
    return summed.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Words, counts, (base, first, last) and begins of blocks; a block that the next batch may go on with waits for it."""
    rest: pa.Table | None = None
    for batch in _then_none(batches):
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if rest is not None:
            table = pa.concat_tables([rest, table]) if table is not None else rest
        if table is None or not table.num_rows:
            continue
        key = table.column("key").to_numpy()
        where = [table.column(c).to_numpy() for c in ("base", "first", "last")]
        new = np.zeros(len(key), bool)
        new[0] = True
        for column in (key, *where):
            new[1:] |= column[1:] != column[:-1]
        begins = np.flatnonzero(new)
        if batch is not None:
            rest = table.slice(int(begins[-1]))
            table, begins = table.slice(0, int(begins[-1])), begins[:-1]
        if len(begins):
            end = table.num_rows
            yield table.column("word").to_pylist(), table.column("n").to_numpy(), [w[:end] for w in where], begins


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word on the way of forms, for words (word, form) that have one.

    A form occurs at least twice as often as its word, so ways end. Each turn doubles the steps that a word looks ahead.
    """
    known = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        further = known.join(ahead, "root", "left")
        further = saved(further.select("word", F.coalesce("ahead", "root").alias("root"), "ahead"), "roots")
        known = further.select("word", "root")
        if further.where("ahead IS NOT NULL").isEmpty():
            return known


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words of ``docs`` that occur often enough."""
    words = saved(count_words(docs).where(F.col("n") >= least_count), "words")
    near = near_words(blocks(words))
    found = saved(words.join(near, "word", "left"), "near")
    often = F.col("form_n") >= times * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(often, F.col("form")).alias("form"), F.when(often, F.col("form_n")).alias("form_n"),
    )
    ends = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
