"""Near duplicates by MinHash bands, with odd sketches to verify candidates.

Every text has its set of word shingles. Texts with one and the same set form a class, whose smallest row stands for it. For each
class, ``HASHES`` MinHash samples give ``BANDS`` band keys, and are folded into an odd sketch: a bitmap in which every sample
toggles one bit. Where two sketches differ tells how many samples differ, closely so for similar sets.

Links are found in two steps that never write out the pairs of a bucket. First each class of a band bucket is compared with
the bucket's smallest class: sizes, then sketches, then the full sets. The links give components. Second, the classes of one
bucket that lie in different components are compared, in cells of bounded size: first by sketches, which gives clusters of
components that may be linked, then by full sets inside the clusters. A cell returns only the pairs that join its components.
Pairs inside one component need no check, as they can't change it.

Two sets of similarity J share a band with probability 1 - (1 - J**4)**32: all but 5 in 10**8 pairs at 0.8. The sketch bound lies
five standard deviations under the wanted similarity.

Null and empty texts have no shingles and are linked with nothing. Null doc_ids take part, and are never a group's smallest id
unless all are null. Rows that repeat wholly are one class; all rows with their component's doc_id are kept. An empty table
gives no rows. Other columns are ignored. Row ids are written once, before anything reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered_once, saved
from .components import components
from .shingles import mixed, shingle_sets

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BITS = 512
WORDS64 = BITS // 64
#: Rows of a bucket or cluster that meet as many others in one cell.
CELL = 512

_random = np.random.default_rng(20240229)
_TIMES = (_random.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_PLUS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

SKETCH = [f"s{k}" for k in range(WORDS64)]
SIGNATURE = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("uid", "doc_id", "n", "f1", "f2")]
    + [T.StructField("bands", T.ArrayType(T.LongType()))]
    + [T.StructField(c, T.LongType()) for c in SKETCH]
)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that is not empty."""
    x = shingles.astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(least, (x[k : k + 512, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return least


def odd_sketches(all_samples: np.ndarray) -> np.ndarray:
    """Sets of samples (rows) as bitmaps in which every sample toggled one bit; int64 words."""
    bit = (mixed(all_samples.astype(np.uint64) + _BAND) % np.uint64(BITS)).astype(np.int64)
    bit += np.arange(len(bit))[:, None] * BITS
    odd = np.bincount(bit.reshape(-1), minlength=len(bit) * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(bit), BITS), axis=1).view(np.int64)


def most_differing(similarity: float) -> int:
    """Differing bits that two sketches of sets this similar have at most, but for five standard deviations."""
    low = similarity - 5 * (similarity * (1 - similarity) / HASHES) ** 0.5
    return int(np.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * HASHES * (1 - low)))))


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """Set size, fingerprint, band keys and odd sketch of every row (uid, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = shingle_sets(some.column("text").to_pylist(), width)
                mins = np.zeros((len(sets), HASHES), np.uint32)
                prints = np.zeros((2, len(sets)), np.uint64)
                for k, s in enumerate(sets):
                    if len(s):
                        mins[k] = samples(s)
                        prints[0, k] = mixed(s).sum()
                        prints[1, k] = mixed(s ^ _BAND[0]).sum()
                keys = mixed((mins.astype(np.uint64) + np.uint64(1)) * _BAND).reshape(len(sets), BANDS, ROWS)
                keys = mixed(keys.sum(axis=2) + _BAND[:BANDS]).view(np.int64)
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1))
                )
                sizes = pa.array(np.array([len(s) for s in sets], np.int64))
                words = odd_sketches(mins).reshape(len(sets), WORDS64) if len(sets) else np.empty((0, WORDS64), np.int64)
                columns = [
                    some.column("uid"), some.column("doc_id"), sizes, *[pa.array(p.view(np.int64)) for p in prints], bands,
                    *[pa.array(np.ascontiguousarray(w)) for w in words.T],
                ]
                yield pa.record_batch(columns, SIGNATURE.names)

    return rows.mapInArrow(run, SIGNATURE)


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                left = shingle_sets(some.column("text_a").to_pylist(), width)
                right = shingle_sets(some.column("text_b").to_pylist(), width)
                ok = np.zeros(len(left), bool)
                for k, (x, y) in enumerate(zip(left, right)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[k] = 100 * both >= percent * (len(x) + len(y) - both)
                keep = pa.array(ok)
                yield pa.record_batch([some.column("a").filter(keep), some.column("b").filter(keep)], ["a", "b"])

    a = texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


def _star_pairs(members: DataFrame, leaders: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b): the smallest class of a bucket and another of it, where sizes and sketches allow a link."""
    pairs = members.join(leaders, "key").where("uid <> leader").select(F.col("leader").alias("a"), F.col("uid").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(*[F.col(c).alias(side if c == "uid" else f"{c}_{side}") for c in sketches.columns]), side)
    differ = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in SKETCH), F.lit(0))
    near = _similar_sizes(F.col("n_a"), F.col("n_b"), percent) & (differ <= most_differing(percent / 100))
    return pairs.where(near).select("a", "b")


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The sorted rows of a partition, a table per key."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
        edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for x, y in zip(edges, edges[1:]):
            if held and tuple(values[x]) != name:
                yield pa.Table.from_batches(held)
                held = []
            name = tuple(values[x])
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _joins(cell: pa.Table, percent: int, exact: bool) -> tuple[list[int], list[int]]:
    """Rows of a cell that join two of its components: as few pairs as tell which of them are linked.

    ``exact`` compares the full sets of what sizes and sketches allow, else those two decide.
    """
    most = most_differing(percent / 100)
    part, root, n = (cell.column(c).to_numpy() for c in ("part", "label", "n"))
    root = root.copy()
    bits = np.stack([cell.column(c).to_numpy() for c in SKETCH], axis=1).view(np.uint64)
    sets = [np.frombuffer(x, np.uint64) for x in cell.column("set").to_pylist()] if exact else []
    left = np.flatnonzero(part == part.min())
    own = len(left) == len(part)  # a cell of one part with itself
    right = left if own else np.flatnonzero(part != part.min())
    a, b = [], []
    for k in left.tolist():
        some = right[right > k] if own else right
        some = some[(root[some] != root[k]) & (100 * np.minimum(n[some], n[k]) >= percent * np.maximum(n[some], n[k]))]
        if len(some):
            some = some[np.bitwise_count(bits[some] ^ bits[k]).sum(axis=1) <= most]
        if len(some) and exact:
            flat = np.concatenate([sets[x] for x in some.tolist()])
            hit = sets[k][np.minimum(np.searchsorted(sets[k], flat), len(sets[k]) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[some]) - n[some])
            some = some[100 * both >= percent * (n[some] + n[k] - both)]
        for x in some.tolist():
            if root[x] != root[k]:
                a.append(k), b.append(x)
                root[root == root[x]] = root[k]
    return a, b


def _celled(rows: DataFrame, group: str, size: str, percent: int, exact: bool, out: str) -> DataFrame:
    """Pairs (a, b) of values of ``out`` that join components of one ``group``, from cells of at most two parts of it."""
    keys = (group, "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, keys):
            a, b = _joins(cell, percent, exact)
            named = cell.column(out).to_numpy()
            yield pa.record_batch([pa.array(named[np.array(x, np.int64)], pa.int64()) for x in (a, b)], ["a", "b"])

    parts = F.ceil(F.col(size) / CELL).cast("int")
    rows = rows.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("uid"), parts).cast("int")})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    kept = ["part", "uid", "label", "n", *SKETCH, *(["set"] if exact else [])]
    return rows.select(*keys, *kept).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """Rows (..., text) with the text's set instead, as sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found = [x.tobytes() for x in shingle_sets(some.column("text").to_pylist(), width)]
                some = some.drop_columns(["text"])
                yield some.append_column("set", pa.array(found, pa.binary()))

    schema = T.StructType([f for f in rows.schema if f.name != "text"] + [T.StructField("set", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def _across(members: DataFrame, buckets: DataFrame, sketches: DataFrame, texts: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components that no leader showed.

    First the sketches tell, bucket by bucket, which components may be linked at all; of their pairs only as many come out as
    hold them together. Components held together so form a cluster, in which the full sets of different components meet.
    """
    joined = members.join(buckets.where("count > 2").select("key", "count"), "key")
    joined = joined.join(labels, F.col("uid") == F.col("node"), "left")
    joined = saved(joined.select("key", "count", "uid", F.coalesce("label", "uid").alias("label")), "large")
    several = joined.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    rows = joined.join(several, "key", "left_semi").join(sketches, "uid")
    touching = saved(_celled(rows, "key", "count", percent, False, "label").distinct(), "touching")
    if touching.isEmpty():
        return touching
    clusters = components(touching).select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    rows = sketches.join(labels, F.col("uid") == F.col("node"), "left").drop("node")
    rows = rows.withColumn("label", F.coalesce("label", "uid")).join(clusters, "label").join(texts, "uid")
    rows = saved(_sets(rows, width), "sets")
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return saved(_celled(rows.join(sizes, "cluster"), "cluster", "size", percent, True, "uid").distinct(), "across")


def link(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """uid, doc_id, n_shingles, component, component_id, kept of every document.

    ``component`` is a uid that all rows of a component share; null for texts without shingles.
    """
    rows = numbered_once(docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return link_rows(rows, width, percent)


def link_rows(rows: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """``link`` for rows (uid, doc_id, text) whose ids stay the same in every job, as those of ``numbered_once`` do."""
    signed = saved(signatures(rows, width), "signatures")
    classes = saved(
        signed.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("uid").alias("class"), F.min("doc_id").alias("least")),
        "classes",
    )
    one = signed.join(classes.select(F.col("class").alias("uid")), "uid", "left_semi")
    members = one.select(F.explode("bands").alias("key"), "uid")
    buckets = members.groupBy("key").agg(F.min("uid").alias("leader"), F.count(F.lit(1)).alias("count")).where("count > 1")
    buckets = saved(buckets, "bands")
    members = saved(members.join(buckets.select("key"), "key", "left_semi"), "members")
    needed = members.select("uid").distinct()
    sketches = saved(one.select("uid", "n", *SKETCH).join(needed, "uid", "left_semi"), "sketches")
    texts = saved(rows.select("uid", "text").join(needed, "uid", "left_semi"), "texts")

    tried = saved(_star_pairs(members, buckets.select("key", "leader"), sketches, percent), "pairs")
    links = saved(_verified(tried, texts, width, percent), "links")
    labels = components(links)
    across = _across(members, buckets, sketches, texts, labels, width, percent)
    if not across.isEmpty():
        labels = components(saved(links.unionByName(across), "all-links"))

    grouped = classes.join(labels, F.col("class") == F.col("node"), "left")
    grouped = grouped.withColumn("label", F.coalesce("label", "class"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    grouped = grouped.join(least, "label").select("n", "f1", "f2", "label", "component_id")
    out = signed.select("uid", "doc_id", "n", "f1", "f2").join(grouped, ["n", "f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "uid", "doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component"), component.alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
