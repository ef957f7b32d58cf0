"""Quality rules with adaptive thresholds per language and source.

Documents are measured one by one. The measures of those that pass the base rules go into quantile sketches: counts by language,
source, measure and logarithmic bucket, which have a fixed relative error, merge by addition and do not depend on order.
Fences follow from the quartiles of a document's (language, source) sketch; where that has few documents, from the language's
merged sketch, then from all. A join brings the fences to the documents, and those outside are filtered.

Null text has no words, so it fails the base rules. Null languages and sources are groups of their own. Rows that repeat are
judged one by one. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved
from .tokens import UNUSUAL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Documents of more words are compared by word numbers, which take less memory than tuples.
MANY_WORDS = 200_000

#: Relative error of the quantiles, and the least documents of a group with fences of its own.
ERROR, LEAST_GROUP = 0.01, 100
GAMMA = (1 + ERROR) / (1 - ERROR)
ZERO = -100_000
#: Fences lie this many quartile distances outside the quartiles; a distance counts as the given value at least.
REACH = 3.0
MEASURES = {"word_length": (1.0, True), "symbols": (0.02, False), "dup_lines": (0.1, False), "repeats": (0.05, False)}

MEASURED = (
    "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, "
    "n_dup_lines bigint, n_repeat_words bigint"
)


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that the text has twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if len(words) <= MANY_WORDS:
        windows = list(zip(*[words[k:] for k in range(width)]))
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        again = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    else:
        numbers: dict[str, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        code = ids[:n]
        for k in range(1, width):
            code = np.unique(code * len(numbers) + ids[k : k + n], return_inverse=True)[1]
        again = np.bincount(code)[code] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, lines with a word, those equal to an earlier one, repeated words."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = WORDS.findall(text) if UNUSUAL.search(text) else text.split()
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    symbols = sum(text.count(c) for c in SYMBOLS)
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
        for batch in batches:
            found = np.array([measures(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(names))
            kept = [batch.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.record_batch([*kept, *[pa.array(c) for c in found.T]], ["doc_id", "lang", "source", *names])

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]
    )
    return rows.mapInArrow(run, MEASURED)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _values() -> dict[str, Column]:
    one = F.lit(1)
    return {
        "word_length": F.col("word_chars") / F.greatest("n_words", one),
        "symbols": F.col("n_symbols") / F.greatest("word_chars", one),
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", one),
        "repeats": F.col("n_repeat_words") / F.greatest("n_words", one),
    }


def sketches(facts: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the mergeable sketches of the documents that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in _values().items()])).alias("m")
    rows = facts.where(~base_failed()).select("lang", "source", pairs)
    bucket = F.when(F.col("m.value") <= 1e-9, ZERO).otherwise(F.ceil(F.ln("m.value") / log(GAMMA))).cast("int")
    return rows.groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def merged(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(parts: DataFrame, *by: str) -> DataFrame:
    """A row per group with ``documents`` and the fences ``low_*`` and ``high_*`` of every measure."""
    group = Window.partitionBy(*by, "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = merged(parts, *by).withColumns({"all": F.sum("n").over(group), "reach": F.sum("n").over(upto)})
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    quartile = {k: F.min(F.when(F.col("reach") >= share * F.col("all"), value)) for k, share in (("q1", 0.25), ("q3", 0.75))}
    rows = rows.groupBy(*by, "measure").agg(F.max("all").alias("all"), *[v.alias(k) for k, v in quartile.items()])
    out = [F.max("all").alias("documents")]
    for name, (least, both) in MEASURES.items():
        reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        of = F.col("measure") == name
        out.append(F.max(F.when(of, F.col("q3") + reach)).alias(f"high_{name}"))
        if both:
            out.append(F.max(F.when(of, F.col("q1") - reach)).alias(f"low_{name}"))
    return rows.groupBy(*by).agg(*out)


def judge(docs: DataFrame) -> DataFrame:
    """Measures of every document with base_failed and kept."""
    facts = saved(measured(docs), "quality")
    parts = saved(sketches(facts), "sketches")
    names = [f"high_{m}" for m in MEASURES] + [f"low_{m}" for m, (_, both) in MEASURES.items() if both]
    own = fences(parts, "lang", "source")
    lang = fences(parts, "lang").select(F.col("lang").alias("l"), F.col("documents").alias("d"), *[F.col(n).alias(f"l_{n}") for n in names])
    everywhere = fences(parts).select(*[F.col(n).alias(f"a_{n}") for n in names])
    few, few_lang = F.col("documents") < LEAST_GROUP, F.col("d") < LEAST_GROUP
    best = own.join(lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("one", F.lit(1))
    best = best.join(everywhere.withColumn("one", F.lit(1)), "one", "left")  # one row, brought to a row per group
    best = saved(
        best.select(
            F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
            *[F.when(few & few_lang, F.col(f"a_{n}")).when(few, F.col(f"l_{n}")).otherwise(F.col(n)).alias(n) for n in names],
        ),
        "fences",
    )
    rows = facts.join(
        best, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left"
    )
    inside = F.lit(True)
    for name, value in _values().items():
        inside = inside & (value <= F.col(f"high_{name}"))
        if MEASURES[name][1]:
            inside = inside & (value >= F.col(f"low_{name}"))
    rows = rows.withColumn("base_failed", base_failed())
    rows = rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
    return rows.drop("g_lang", "g_source", *names)
