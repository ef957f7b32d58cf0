"""Packing documents into sequences of fixed length by cutting stock.

A document of n ids gives n // length full sequences and a rest. The rests' lengths, in classes of ``GRAIN`` ids, form a
histogram of at most length / GRAIN bins. The driver solves its cutting-stock program (``cutting_stock``) and the rounded
patterns lay out slots: so many sequences, each with so many pieces of each class. Rests are ranked within their class, and a
rank leads straight to a sequence. Only patterns that fill a sequence but for its last class are used. What they and rounding
leave over is laid end to end, by running totals over range partitions, and cut at the sequence length; its tail is cut into
powers of two, which need no padding.

Null text is the empty text: the end id alone. Null or repeated doc_ids are separate documents. An empty table gives no
pieces. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import numbered, part_starts, saved, with_columns
from .cutting_stock import patterns
from .tokens import encoder, some_texts, with_end

GRAIN = 4

ENCODED = "uid bigint, doc_id bigint, part bigint, full_before bigint, n bigint, ids binary"


def encode(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """A row per document with its ids (little-endian uint32, end id included) and the full sequences before it in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, full = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        for batch in batches:
            for some in some_texts(batch):
                ids, sizes = with_end(*enc.encode(some.column("text")), end_id)
                ends = np.cumsum(sizes)
                bytes_at = np.concatenate([[0], ends * 4]).astype(np.int32)
                held = pa.Array.from_buffers(
                    pa.binary(), len(sizes), [None, pa.py_buffer(bytes_at), pa.py_buffer(ids.astype("<u4"))]
                )
                whole = np.cumsum(sizes // length)
                columns = [
                    some.column("uid"), some.column("doc_id"), pa.array(np.full(len(sizes), part)),
                    pa.array(full + whole - sizes // length), pa.array(sizes), held,
                ]
                full += int(whole[-1]) if len(whole) else 0
                yield pa.record_batch(columns, ["uid", "doc_id", "part", "full_before", "n", "ids"])

    rows = numbered(docs, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ENCODED)


def _running(rows: DataFrame, groups: str, value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of the same ``groups`` value that come earlier by uid.

    Range partitions sum up on their own; what the partitions before hold is added afterwards.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            kinds, values = batch.column(groups).to_numpy(), batch.column(value).to_numpy()
            local = np.empty(len(kinds), np.int64)
            for kind in np.unique(kinds).tolist():  # few: at most one per class
                at = np.flatnonzero(kinds == kind)
                ends = seen.get(kind, 0) + np.cumsum(values[at])
                local[at] = ends - values[at]
                seen[kind] = int(ends[-1])
            columns = [*batch.columns, pa.array(np.full(len(kinds), part)), pa.array(local)]
            yield pa.record_batch(columns, [*batch.schema.names, "range", "local"])

    ordered = rows.repartitionByRange(groups, "uid").sortWithinPartitions(groups, "uid")
    local = saved(ordered.mapInArrow(count, with_columns(rows.schema, range=T.LongType(), local=T.LongType())), "running")
    earlier = Window.partitionBy(groups).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = local.groupBy(groups, "range").agg(F.sum(value).alias("held"))
    held = held.select(groups, "range", F.coalesce(F.sum("held").over(earlier), F.lit(0)).cast("bigint").alias("earlier"))
    # A range holds several groups only where they are small: at most ranges plus groups rows.
    return local.join(F.broadcast(held), [groups, "range"]).select(
        *rows.columns, (F.col("earlier") + F.col("local")).alias("before")
    )


def _slots(mix: list[tuple[int, dict[int, int]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each class its runs of slots: (first rank, sequences' first number, pieces in each sequence, place)."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pieces in mix:
        place = 0
        for kind in sorted(pieces, reverse=True):
            slots.setdefault(kind, []).append((used.get(kind, 0), sequence, pieces[kind], place))
            used[kind] = used.get(kind, 0) + times * pieces[kind]
            place += pieces[kind]
        sequence += times
    return {k: [*v, (used[k], -1, 1, 0)] for k, v in slots.items()}


def _placed(ranked: DataFrame, mix: list[tuple[int, dict[int, int]]]) -> DataFrame:
    """Each rest with its sequence and place in it; sequence null for what the rounded patterns leave over."""
    slots = _slots(mix)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ranks = batch.column("kind").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.full(len(kinds), -1, np.int64)
            places = np.zeros(len(kinds), np.int64)
            for kind in np.unique(kinds):
                if int(kind) not in slots:
                    continue
                first, base, pieces, offset = np.array(slots[int(kind)]).T
                at = np.flatnonzero(kinds == kind)
                run = np.searchsorted(first, ranks[at], "right") - 1
                step = ranks[at] - first[run]
                held = base[run] >= 0
                sequence[at] = np.where(held, base[run] + step // pieces[run], -1)
                places[at] = offset[run] + step % pieces[run]
            columns = [batch.column("uid"), batch.column("rest"), pa.array(sequence, mask=sequence < 0), pa.array(places)]
            yield pa.record_batch(columns, ["uid", "rest", "sequence_id", "place"])

    return ranked.mapInArrow(place, "uid bigint, rest bigint, sequence_id bigint, place bigint")


def _borders(total: int, length: int) -> list[int]:
    """Where the tail of the left-over ids is cut: after the last whole sequence, then by powers of two."""
    at, borders = total - total % length, []
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        borders.append(at)
    return borders


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """Pieces: uid, doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    encoded = saved(encode(docs, tokenizer, end_id, length), "packing")
    size = F.lit(length).cast("bigint")
    rests = encoded.select("uid", (F.col("n") % size).alias("rest")).where("rest > 0")
    rests = rests.withColumn("kind", F.expr(f"(rest + {GRAIN - 1}) div {GRAIN}"))
    histogram = {r["kind"]: r["count"] for r in rests.groupBy("kind").count().collect()}  # at most length / GRAIN rows
    mix = patterns(histogram, length // GRAIN, least_fill=length // GRAIN)
    ranked = _running(rests.withColumn("one", F.lit(1).cast("bigint")), "kind", "one").withColumnRenamed("before", "rank")
    placed = saved(_placed(ranked, mix), "placed")

    first_left = sum(times for times, _ in mix)
    within = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    fitted = placed.where("sequence_id is not null").select(
        "uid", F.lit(0).cast("bigint").alias("skip"), F.col("rest").alias("length"), "sequence_id",
        F.coalesce(F.sum("rest").over(within), F.lit(0)).cast("bigint").alias("offset"),
    )

    left = placed.where("sequence_id is null").select("uid", "rest", F.lit(0).cast("bigint").alias("all"))
    total = left.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    left = _running(left, "all", "rest").withColumnRenamed("before", "from")
    tail = _borders(total, length)
    whole = total // length
    starts = F.array(*[F.lit(b).cast("bigint") for b in [whole * length, *tail[:-1]]]) if tail else F.array().cast("array<bigint>")
    ends = F.array(*[F.lit(b).cast("bigint") for b in tail]) if tail else F.array().cast("array<bigint>")
    last = F.least(F.expr(f"(`from` + rest - 1) div {length}"), F.lit(whole - 1).cast("bigint"))
    first = F.expr(f"`from` div {length}")
    boxes = F.when(first <= last, F.transform(F.sequence(first, last), lambda i: F.struct((i * size).alias("a"), ((i + 1) * size).alias("b"), i.alias("i"))))
    tails = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda t, i: F.struct(t["a"].alias("a"), t["b"].alias("b"), (i + F.lit(whole)).cast("bigint").alias("i")))
    boxes = F.concat(F.coalesce(boxes, F.array().cast("array<struct<a:bigint,b:bigint,i:bigint>>")), tails)
    cut = left.select("uid", "rest", "from", F.explode(boxes).alias("box")).where("box.a < `from` + rest and box.b > `from`")
    begin, end = F.greatest("from", F.col("box.a")), F.least(F.col("from") + F.col("rest"), F.col("box.b"))
    cut = cut.select(
        "uid", (begin - F.col("from")).alias("skip"), (end - begin).alias("length"),
        (F.col("box.i") + first_left).alias("sequence_id"), (begin - F.col("box.a")).alias("offset"),
    )

    ends_of_rests = fitted.unionByName(cut).groupBy("uid").agg(
        F.collect_list(F.struct("skip", "length", "sequence_id", "offset")).alias("rests")
    )
    first_full = first_left + whole + len(tail)
    # A row per task that encoded.
    parts = encoded.groupBy("part").agg(F.max(F.col("full_before") + F.expr(f"n div {length}")).alias("full"))
    full = F.expr(f"n div {length}")
    starts_of_parts = part_starts(parts, "part", "full").withColumnRenamed("full_before", "full_of_parts_before")
    rows = encoded.join(ends_of_rests, "uid", "left").join(F.broadcast(starts_of_parts), "part")
    fulls = F.when(
        full > 0,
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), full - 1),
            lambda i: F.struct(
                (i * size).alias("start"), size.alias("length"),
                (F.lit(first_full) + F.col("full_before_all") + i).alias("sequence_id"),
                F.lit(0).cast("bigint").alias("offset"),
            ),
        ),
    )
    others = F.transform(
        "rests",
        lambda r: F.struct(
            (full * size + r["skip"]).alias("start"), r["length"].alias("length"),
            r["sequence_id"].alias("sequence_id"), r["offset"].alias("offset"),
        ),
    )
    none = F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>")
    rows = rows.withColumn("full_before_all", F.col("full_before") + F.col("full_of_parts_before"))
    pieces = F.concat(F.coalesce(fulls, none), F.coalesce(others, none))
    rows = rows.select("uid", "doc_id", F.col("n").alias("doc_tokens"), "ids", F.explode(pieces).alias("p"))
    return rows.select(
        "uid", "doc_id", "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset",
        F.substring("ids", F.col("p.start").cast("int") * 4 + 1, F.col("p.length").cast("int") * 4).alias("ids"),
    )
