"""A corpus from raw documents to packed sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fleetroll.llm import languages, mixing, near_dup, packing, repeats  # noqa: E402
from fleetroll.llm.common import numbered_once, saved  # noqa: E402
from fleetroll.llm.queries import tokenizer_file  # noqa: E402

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages that were learned from the labelled ones, one or several; rejected is what fits none of them."""
    langs, model = languages.train(docs.where(~languages.held_out()))
    found = languages.predict(docs, langs, model)
    least, deviation = languages.least_fit(model)
    fits = F.col("fit") >= F.lit(least) - F.lit(3 * deviation) / F.sqrt(F.greatest("trigrams", F.lit(1)))
    return found.where((F.col("lang_pred") != languages.UNKNOWN) & fits).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; five-word shingles, 80 percent."""
    rows = numbered_once(docs, F.struct("*").alias("row"))
    doc_id, text = F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").cast("string").alias("text")
    linked = near_dup.link_rows(rows.select("uid", doc_id, text), width=5, percent=80)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")).alias("first")
    stay = linked.where("n_shingles > 0").groupBy("component").agg(first).select("first.uid")
    stay = stay.unionByName(linked.where("n_shingles = 0").select("uid"))
    return rows.join(saved(stay, "stay"), "uid", "left_semi").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages of 200 bytes that stand anywhere else as well."""
    cleaned = repeats.remove_repeats(docs, 200, as_text=True)
    given = set(docs.columns)
    value = {
        "text": F.col("kept"),
        "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType if "n_chars" in given else "bigint"),
    }
    return cleaned.select(*[value[c].alias(c) if c in value else F.col(f"row.{c}") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    limits = mixing.thresholds(mixing.measured(docs))
    text = F.col("text").cast("string").alias("text")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text, "source")
    keyed = keyed.select("row", F.col("source").cast("string").alias("source"), mixing.place().alias("hash"))
    taken = mixing.times(keyed, limits).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    pieces = packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, length=2048)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packed", packed),
]

#: Stages of trained models and tokenizers have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
