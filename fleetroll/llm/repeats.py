"""Repeated passages by the common-prefix interval tree of an enhanced suffix array.

A passage of ``length`` bytes is repeated when the same bytes start anywhere else. Suffixes are compared at anchors: positions
whose 32-byte gram has the smallest hash of some passage around it. Which positions of a passage are anchors depends on its
bytes alone, so two equal passages have anchors at the same places, and only suffixes at anchors whose gram is repeated
have to meet. Each brings its context, the bytes around it that passages through the anchor can cover.

Contexts with one gram come to one task, which sorts them by the bytes from the anchor on (the suffix array), takes common
prefixes of neighbours, and scans them with a stack: every interval of the tree is a string that its members share. They are
sorted once more by the bytes before the anchor, read backwards. Inside an interval, the runs of that second order whose members
differ in what comes before and in what follows are the maximal repeats. All members of a maximal repeat, and no others, have
their first rank in the interval and their second rank in the run; so a group is written as these two ranges, of one size
however many occurrences it has, and each context is written with its two ranks (``repeat_groups``, ``occurrences``). What a
document loses is what the groups of its contexts cover (``covered``). Equal contexts are counted before they are dealt out, so
copies never meet; they are a group of their own.

In a run of one byte or of a period of at most 32 bytes every period would be an anchor. There the run itself is a repeat that
needs no partner: it is kept as (from, to), and only the anchors near its ends, and two whose contexts lie inside, go on to meet
others. A gram with more than ``MOST_CONTEXTS`` different contexts is compared window by window through sums instead, which
gives the same bytes but no groups.

Null texts are empty. Texts shorter than ``length`` repeat nothing. Very long texts are read whole, and take memory in proportion
(about 60 bytes a byte while their anchors are found). Rows that repeat wholly are documents of their own, so they
repeat each other. Ties of the smallest hash are all anchors. Null or repeated doc_ids do no harm: rows have ids of their own. An
empty table gives no rows. Other columns are ignored. Row ids are written once, before anything reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered_once, saved
from .shingles import mixed

GRAM = 32
MOST_CONTEXTS = 100_000
#: Contexts that a task scans at once, bytes of text whose anchors it finds at once, and bytes of contexts that it writes at once.
SCANNED, SLICE, WRITTEN = 5_000, 1 << 19, 1 << 22
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of every run of ``size`` bytes, a power of two; as many as there are bytes, the last ones without meaning."""
    h = np.zeros(len(data) + size, np.uint64)
    h[: len(data)] = data
    h += np.uint64(1)
    times, width = int(_TIMES), 1
    while width < size:
        h[:-width] = h[:-width] * np.uint64(times) + h[width:]
        times, width = times * times & (1 << 64) - 1, 2 * width
    return mixed(h[: len(data)])


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The smallest or largest of every ``width`` values from each place on; len(x) - width + 1 of them."""
    pick = np.minimum if least else np.maximum
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, gram hash) of all anchors of texts that stand one after the other in ``data``."""
    steps = length - GRAM + 1
    sizes = np.diff(ends, prepend=0)
    if len(data) < length:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    h = gram_hashes(data)
    least = _sliding(h, steps, True)[: len(data) - length + 1]  # of the passage that starts there
    # Passages that would run over the end of their text do not count.
    bounds = np.zeros(len(data) + 1, np.int32)
    over = np.maximum(ends - length + 1, ends - sizes)
    np.add.at(bounds, over, 1)
    np.add.at(bounds, ends, -1)
    outside = np.cumsum(bounds)[: len(least)] > 0
    inside = np.zeros(len(data) + steps - 1, np.uint64)
    inside[steps - 1 : steps - 1 + len(least)] = np.where(outside, 0, least)
    most = _sliding(inside, steps, False)  # of the passages that hold the gram at a place
    at = np.flatnonzero((h == most) & (most > 0))
    text = np.searchsorted(ends, at, "right")
    return text, at - (ends - sizes)[text], h[at]


def periodic(text: np.ndarray, place: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that a run of a short period makes needless, as a mask; and (text, from, to) of those runs.

    Anchors with one gram at one distance of at most ``GRAM`` follow each other in such a run, as grams overlap or touch.
    """
    n, gap = len(place), np.diff(place)
    follows = (text[1:] == text[:-1]) & (key[1:] == key[:-1]) & (gap <= GRAM)
    goes_on = follows[1:] & follows[:-1] & (gap[1:] == gap[:-1])
    starts, stops = follows.copy(), follows.copy()
    starts[1:] &= ~goes_on
    stops[:-1] &= ~goes_on
    begin, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    needless, runs = np.zeros(n, bool), []
    # Two anchors with whole contexts in the run stay, so that the run's passages have a count and partners elsewhere.
    inner = place[end] + GRAM - place[begin] >= 2 * length - GRAM
    for x, y in zip(begin[inner].tolist(), end[inner].tolist()):
        first, last, period = place[x], place[y] + GRAM, place[x + 1] - place[x]
        own = place[x : y + 1]
        drop = (own - (length - GRAM) - 2 * period >= first) & (own + length <= last)
        if drop.any():
            needless[x : y + 1] |= drop
            runs.append((text[x], first, last))
    return needless, np.array(runs, np.int64).reshape(-1, 3)


def find_anchors(rows: DataFrame, length: int) -> DataFrame:
    """uid, place, key of anchors; and periodic runs, without a key, with their end in ``to``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "place", "key", "to"]
        for batch in batches:
            uids, text = batch.column("uid").to_numpy(), batch.column("text").cast(pa.large_string())
            _, offsets, data = text.buffers()
            at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
            begin = 0
            while begin < len(uids):
                end = max(begin + 1, int(np.searchsorted(at, at[begin] + SLICE, "left")))
                end = min(end, len(uids))
                own, place, key = anchors(data[at[begin] : at[end]], at[begin + 1 : end + 1] - at[begin], length)
                needless, runs = periodic(own, place, key, length)
                stay = ~needless
                own, place, key = uids[begin:end][own[stay]], place[stay], key[stay].view(np.int64)
                columns = [pa.array(own), pa.array(place), pa.array(key), pa.nulls(len(own), pa.int64())]
                yield pa.record_batch(columns, names)
                if len(runs):
                    columns = [uids[begin:end][runs[:, 0]], runs[:, 1], pa.nulls(len(runs), pa.int64()), runs[:, 2]]
                    yield pa.record_batch([pa.array(c) for c in columns], names)
                begin = end

    return rows.mapInArrow(run, "uid bigint, place bigint, key bigint, to bigint")


def contexts(rows: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """uid, place, key, before (bytes before the anchor), context of the anchors in ``places``."""
    back = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(WRITTEN // (back + length), 1)
        for batch in batches:
            own = batch.column("own")
            bounds = own.offsets.to_numpy()
            place, key = (own.values.field(c).to_numpy() for c in ("place", "key"))
            uid = np.repeat(batch.column("uid").to_numpy(), np.diff(bounds))
            place, key = place[bounds[0] : bounds[-1]], key[bounds[0] : bounds[-1]]
            texts, bounds = batch.column("text"), bounds - bounds[0]
            document, data = -1, b""
            for x in range(0, len(place), most):
                found = []
                whose = np.searchsorted(bounds, np.arange(x, min(x + most, len(place))), "right") - 1
                for k, p in zip(whose.tolist(), place[x : x + most].tolist()):
                    if k != document:
                        document, data = k, texts[k].as_py().encode()
                    found.append(data[max(p - back, 0) : p + length])
                columns = [v[x : x + most] for v in (uid, place, key, np.minimum(place, back))]
                columns = [*[pa.array(c) for c in columns], pa.array(found, pa.binary())]
                yield pa.record_batch(columns, ["uid", "place", "key", "before", "context"])

    own = places.groupBy("uid").agg(F.collect_list(F.struct("place", "key")).alias("own"))  # one document's
    return rows.join(own, "uid").select("uid", "text", "own").mapInArrow(
        run, "uid bigint, place bigint, key bigint, before bigint, context binary"
    )


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(common prefix, first, last) of all intervals of a suffix array with a prefix of at least ``least``; ``lcp[k]`` is that
    of k and k + 1."""
    found, stack = [], []
    for k in range(len(lcp) + 1):
        now = lcp[k] if k < len(lcp) else -1
        first = k
        while stack and stack[-1][0] > now:
            prefix, first = stack.pop()
            if prefix >= least:
                found.append((prefix, first, k))
        if k < len(lcp) and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return found


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many first bytes the rows of two matrices share, at most ``most``."""
    if not len(a):
        return np.empty(0, np.int64)
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


class _Least:
    """The smallest of any run of values, from those of all runs of a power of two."""

    def __init__(self, values: np.ndarray):
        levels = max(len(values).bit_length(), 1)
        self.table = np.zeros((levels, len(values)), np.int16)
        self.table[0] = values
        for k in range(1, levels):
            half, n = 1 << k - 1, len(values) - (1 << k) + 1
            self.table[k, :n] = np.minimum(self.table[k - 1, :n], self.table[k - 1, half : half + n])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of values[begin:end], none of them empty."""
        level = np.frexp(end - begin)[1] - 1
        return np.minimum(self.table[level, begin], self.table[level, end - (1 << level)]).astype(np.int64)


class Contexts:
    """Contexts in two orders: of the bytes from the anchor on (the suffix array) and of those before it, backwards.

    Contexts with one key stand side by side; neighbours of two keys share nothing. Where one is the start of another, as at
    the end of a text, the shorter is first.
    """

    def __init__(self, keys: np.ndarray, before: np.ndarray, found: list[bytes], length: int):
        back, n = length - GRAM, len(keys)
        after = np.fromiter(map(len, found), np.int64, n) - before
        halves = list(zip(found, before.tolist()))
        self.length, self.back = length, back
        right = b"".join([c[p:].ljust(length, b"\0") for c, p in halves])
        self.order, self.prefix = self._sorted(keys, right, after, length)
        left = b"".join([c[:p][::-1].ljust(back, b"\0") for c, p in halves])
        by_left, same = self._sorted(keys, left, before, back)
        rank = np.empty(n, np.int64)
        rank[by_left] = np.arange(n)
        self.left = rank[self.order]  # second rank by first rank
        self.first = np.searchsorted(keys[self.order], keys[self.order], "left")  # where a context's key begins, in both orders
        self.least_ahead, self.least_behind = _Least(self.prefix), _Least(same)
        self.nodes = np.array(intervals(self.prefix.tolist(), GRAM), np.int64).reshape(-1, 3)

    @staticmethod
    def _sorted(keys: np.ndarray, padded: bytes, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((sizes, np.frombuffer(padded, f"S{width}"), keys))
        rows, sizes, keys = np.frombuffer(padded, np.uint8).reshape(-1, width)[order], sizes[order], keys[order]
        shared = _common(rows[1:], rows[:-1], np.minimum(sizes[1:], sizes[:-1]))
        shared[keys[1:] != keys[:-1]] = -1
        return order, shared


def maximal_repeats(c: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal repeats, a row each: first and last rank, first and last second rank, bytes before and after the anchor.

    Also, for every context by first rank, the most bytes before and after its anchor that a repeat of its own holds.
    """
    before, after = np.zeros(len(c.order), np.int64), np.zeros(len(c.order), np.int64)
    ahead, first, last = c.nodes.T
    two = last - first == 1
    ahead, first = ahead[two], first[two]
    pair = c.left[first], c.left[first + 1]
    low, high = np.minimum(*pair), np.maximum(*pair)
    behind = c.least_behind(low, high)
    some = behind + ahead >= c.length
    found = [np.stack([first, first + 1, low, high, behind, ahead], axis=1)[some]]
    for side in (0, 1):
        np.maximum.at(before, first[some] + side, behind[some])
        np.maximum.at(after, first[some] + side, ahead[some])
    for ahead, first, last in c.nodes[~two].tolist():
        ranks = c.left[first : last + 1]
        low, high = ranks.min(), ranks.max()
        if c.least_behind(low, high) == c.back:  # alike before the anchor
            found.append(np.array([[first, last, low, high, c.back, ahead]]))
            before[first : last + 1] = c.back
            np.maximum(after[first : last + 1], ahead, out=after[first : last + 1])
            continue
        rows = np.argsort(ranks)
        ranks = ranks[rows]
        rows += first
        same = c.least_behind(ranks[:-1], ranks[1:])
        if same.max() < c.length - ahead:
            continue
        behind, x, y = np.array(intervals(same.tolist(), c.length - ahead)).T
        # What comes before differs among the members by being an interval; what follows has to differ as well, else
        # the string goes on and a deeper interval has it.
        bounds = np.stack([x, y + 1], axis=1).reshape(-1)
        padded = np.append(rows, rows[-1])  # the last bound may be the end
        least, most = np.minimum.reduceat(padded, bounds)[::2], np.maximum.reduceat(padded, bounds)[::2]
        differ = c.least_ahead(least, most) == ahead
        behind, x, y, least, most = (v[differ] for v in (behind, x, y, least, most))
        found.append(np.stack([least, most, ranks[x], ranks[y], behind, np.full(len(x), ahead)], axis=1))
        for b, u, v in zip(behind.tolist(), x.tolist(), y.tolist()):
            own = rows[u : v + 1]
            before[own] = np.maximum(before[own], b)
            after[own] = np.maximum(after[own], ahead)
    return np.concatenate(found), before, after


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of about ``SCANNED`` rows that never part a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, SCANNED):
            held.append(batch.slice(at, SCANNED))
            if sum(b.num_rows for b in held) >= SCANNED:
                t = pa.Table.from_batches(held)
                keys = t.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on
                if cut:
                    yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


SCANS = "key bigint, hash bigint, first int, last int, left_first int, left_last int, from int, to int"


def _scanned(different: DataFrame, length: int) -> DataFrame:
    """Groups, with a null hash; and contexts, by hash, with their ranks and the widest extent of their groups (null: no group).

    Ranks count from 0 within a key. They depend on the contexts alone, so a task that runs again gives the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in SCANS.split(", ")]

        def batch(*columns: np.ndarray) -> pa.RecordBatch:
            wide = [pa.array(x) for x in columns[:2]]
            return pa.record_batch([*wide, *[pa.array(x).cast(pa.int32()) for x in columns[2:]]], names)

        for t in _scans(batches):
            keys, before, hashes, counts = (t.column(x).to_numpy() for x in ("key", "before", "hash", "count"))
            found = t.column("context").to_pylist()
            c = Contexts(keys, before, found, length)
            groups, behind, ahead = maximal_repeats(c)
            sizes = np.fromiter(map(len, found), np.int64, len(found))[c.order]
            keys, before, hashes = keys[c.order], before[c.order], hashes[c.order]
            copies = np.flatnonzero(counts[c.order] > 1)  # equal contexts repeat all they hold
            behind[copies], ahead[copies] = before[copies], (sizes - before)[copies]
            own = [copies, copies, c.left[copies], c.left[copies], behind[copies], ahead[copies]]
            groups = np.concatenate([groups, np.stack(own, axis=1)])
            zero = c.first[groups[:, 0]]
            first, last, low, high, b, a = groups.T
            none = pa.nulls(len(groups), pa.int64())
            yield batch(keys[first], none, first - zero, last - zero, low - zero, high - zero, -b, a)
            rank, left = np.arange(len(keys)) - c.first, c.left - c.first
            alone = ahead == 0
            start, end = (pa.array(x, mask=alone) for x in (-behind, ahead))
            yield batch(keys, hashes, rank, rank, left, left, start, end)

    dealt = different.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "before", "context", "count", "hash").mapInArrow(run, SCANS)


def _by_windows(different: DataFrame, length: int) -> DataFrame:
    """key, hash, from, to of contexts by sums over their single passages; for grams with very many contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            key, at, own, start = [], [], [], []
            rows = zip(*[batch.column(c).to_pylist() for c in ("key", "hash", "before", "context")])
            for k, h, before, context in rows:
                for p in range(len(context) - length + 1):
                    key.append(k), at.append(h), start.append(p - before)
                    own.append(xxhash.xxh3_128_digest(context[p : p + length]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip((key, at, start, own), kinds)]
            yield pa.record_batch(columns, ["key", "hash", "start", "window"])

    windows = saved(
        different.select("key", "hash", "before", "context").mapInArrow(run, "key bigint, hash bigint, start bigint, window binary"),
        "windows",
    )
    # A passage's place in its context differs, but it is a repeat when two contexts hold it at one place.
    again = windows.groupBy("key", "start", "window").count().where("count > 1")
    hit = windows.join(again.select("key", "start", "window"), ["key", "start", "window"], "left_semi")
    return hit.groupBy("key", "hash").agg(F.min("start").alias("from"), (F.max("start") + length).alias("to"))


class Found(NamedTuple):
    """What a search leaves: rows (uid, row, text), places (uid, place, key, hash), scans, runs (uid, from, to), and extents
    (key, hash, from, to) of the grams that were compared by windows, or None."""

    rows: DataFrame
    places: DataFrame
    scans: DataFrame
    runs: DataFrame
    by_windows: DataFrame | None


def search(docs: DataFrame, length: int = 200, most_contexts: int = MOST_CONTEXTS) -> Found:
    rows = numbered_once(docs, F.struct("*").alias("row")).withColumn("text", F.col("row.text").cast("string"))
    found = saved(find_anchors(rows.select("uid", "text"), length), "anchors")
    runs = found.where("key is null").select("uid", F.col("place").alias("from"), "to")
    found = found.where("key is not null").drop("to")
    again = found.groupBy("key").count().where("count > 1").select("key")
    places = found.join(again, "key", "left_semi")
    near = contexts(rows, places, length).withColumn("hash", F.xxhash64("before", "context"))
    near = saved(near, "contexts")
    different = near.groupBy("key", "before", "context", "hash").agg(F.count(F.lit(1)).alias("count"))
    many = saved(
        near.select("key", "hash").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_contexts),
        "many",
    )
    hot = not many.isEmpty()
    scans = saved(_scanned(different.join(many, "key", "left_anti") if hot else different, length), "scans")
    late = None
    if hot:
        large = different.join(many, "key", "left_semi")
        copies = large.where("count > 1").select(
            "key", "hash", (-F.col("before")).alias("from"), (F.length("context") - F.col("before")).alias("to")
        )
        late = _by_windows(large, length).unionByName(copies)
        late = late.groupBy("key", "hash").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return Found(rows, near.select("uid", "place", "key", "hash"), scans, runs, late)


def repeat_groups(found: Found) -> DataFrame:
    """All maximal repeats: key, ``from`` and ``to`` (bytes from the anchor on), and the ranges of ranks of their members.

    A repeat that reaches over the context of its anchors appears once for each of them, as far as their contexts go.
    """
    return found.scans.where("hash is null").drop("hash")


def occurrences(found: Found, groups: DataFrame) -> DataFrame:
    """All places of the given groups: their columns and uid, ``start``, ``end`` in bytes.

    A document's periodic runs are not told period by period: of their inner contexts two are members.
    """
    ranked = found.scans.where("hash is not null").select("key", "hash", F.col("first").alias("rank"), F.col("left_first").alias("left"))
    members = found.places.join(ranked, ["key", "hash"]).select("key", "rank", "left", "uid", "place")
    inside = F.col("rank").between(F.col("first"), F.col("last")) & F.col("left").between(F.col("left_first"), F.col("left_last"))
    start, end = (F.col("place") + F.col("from")).alias("start"), (F.col("place") + F.col("to")).alias("end")
    return groups.join(members, "key").where(inside).select(*groups.columns, "uid", start, end)


def covered(docs: DataFrame, length: int = 200, most_contexts: int = MOST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """Rows with uid, row (the input's columns), text; and uid with ``spans``, places (from, to) in bytes of repeated passages."""
    found = search(docs, length, most_contexts)
    reach = found.scans.where("hash is not null and to is not null").select("key", "hash", "from", "to")
    if found.by_windows is not None:
        reach = reach.unionByName(found.by_windows)
    at = found.places.join(reach, ["key", "hash"])
    at = at.select("uid", (F.col("place") + F.col("from")).alias("from"), (F.col("place") + F.col("to")).alias("to"))
    spans = at.unionByName(found.runs).groupBy("uid").agg(F.collect_list(F.struct("from", "to")).alias("spans"))  # one document's
    return found.rows, spans


def remove_repeats(docs: DataFrame, length: int = 200, as_text: bool = False, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """row, n_bytes, n_removed, n_spans, kept: the bytes that stay when all that repeated passages cover is gone.

    ``row`` has the input's columns but its text.

    ``as_text`` gives them as a string; bytes of a character that lost others of its bytes are left out there.
    """
    rows, spans = covered(docs, length, most_contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                kept, counts = [], []
                for text, own in zip(some.column("text").to_pylist(), some.column("spans").to_pylist()):
                    data = text.encode() if text else b""
                    pieces, end, removed, runs = [], 0, 0, 0
                    begin = None
                    for x, y in sorted((s["from"], s["to"]) for s in own or ()):
                        if begin is None or x > end:
                            if begin is not None:
                                removed += end - begin
                            pieces.append(data[end if begin is not None else 0 : x])
                            begin, runs, end = x, runs + 1, y
                        end = max(end, y)
                    if begin is not None:
                        removed += end - begin
                    pieces.append(data[end:])
                    left = b"".join(pieces)
                    kept.append(left.decode(errors="ignore") if as_text else left)
                    counts.append((len(data), removed, runs))
                numbers = np.array(counts, np.int64).reshape(-1, 3)
                columns = [some.column("row"), *[pa.array(c) for c in numbers.T]]
                columns.append(pa.array(kept, pa.string() if as_text else pa.binary()))
                yield pa.record_batch(columns, ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = rows.withColumn("row", F.col("row").dropFields("text")).join(spans, "uid", "left").select("row", "text", "spans")
    kind = rows.schema["row"].dataType.simpleString()
    kept_kind = "string" if as_text else "binary"
    return rows.mapInArrow(run, f"row {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept {kept_kind}")
