"""Projections: ids, statuses, request ids, overrides, properties, URIs, outcome codes. No shuffle in any of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (
    deterministic_uuid,
    instance_id_parts,
    join_namespace,
    normalized_path,
    path_tail,
    qualified_uri,
    uri_file_name,
)
from ..model import OUTCOME_CODES, STATUSES, UNEXPECTED_CODE


def parse_instance_ids(df: DataFrame, col: str, mode: str = "suffix") -> DataFrame:
    """Adds ``container_name``, ``instance_uuid`` and ``valid_id``."""
    container, uuid = instance_id_parts(F.col(col), mode)
    return df.withColumns(
        {
            "container_name": container,
            "instance_uuid": uuid,
            "valid_id": F.coalesce(uuid.isNotNull(), F.lit(False)),
        }
    )


def mint_instance_ids(
    df: DataFrame, container: str, seed_cols: Sequence[str] = (), random: bool = False, name: str = "instance_id"
) -> DataFrame:
    """Adds a new id per row. The seed columns must identify the row; ``random`` ignores them."""
    if random:
        uuid = F.uuid()
    else:
        uuid = deterministic_uuid(F.concat_ws(":", F.lit("new"), *[F.col(c).cast("string") for c in seed_cols]))
    return df.withColumn(name, F.concat_ws("-", F.col(container), uuid))


def status_of(text: Column, strict: bool = False) -> Column:
    upper = F.upper(text)
    known = F.when(upper.isin(*STATUSES), upper)
    if not strict:
        return known
    bad = F.raise_error(F.concat(F.lit("Unexpected instance status "), text))
    return F.when(text.isNotNull() & known.isNull(), bad).otherwise(known)


def parse_statuses(df: DataFrame, col: str, strict: bool = False, name: str = "parsed_status") -> DataFrame:
    """Adds the canonical status; unknown text becomes null, or fails the job when ``strict``."""
    return df.withColumn(name, status_of(F.col(col), strict))


def ensure_request_ids(df: DataFrame, seed_col: str | None = None, name: str = "request_id") -> DataFrame:
    """Fills missing request ids, by a hash of the seed column or at random without one."""
    fresh = F.uuid() if seed_col is None else deterministic_uuid(F.concat(F.lit("fill:"), F.col(seed_col).cast("string")))
    return df.withColumn(name, F.coalesce(F.col(name), fresh))


def ids_from_paths(df: DataFrame, col: str) -> DataFrame:
    """Adds ``path`` (normalised), ``instance_id`` (its last element) and the parsed id columns."""
    named = df.withColumn("path", normalized_path(F.col(col))).withColumn("instance_id", path_tail(F.col("path")))
    return parse_instance_ids(named, "instance_id")


def child_namespaces(df: DataFrame, parent: str, child: str, name: str = "namespace") -> DataFrame:
    return df.withColumn(name, join_namespace(F.col(parent), F.col(child)))


def merged_args(request_args: Column, base_args: Column) -> Column:
    """Request arguments first, then those of the definition."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(request_args, none), F.coalesce(base_args, none))


def merged_properties(base: Column, override: Column) -> Column:
    none = F.create_map().cast("map<string,string>")
    extra = F.coalesce(override, none)
    kept = F.map_filter(F.coalesce(base, none), lambda k, _: ~F.map_contains_key(extra, k))
    return F.map_concat(kept, extra)


def apply_overrides(
    df: DataFrame, args: str = "request_jvm_args", properties: str = "request_properties"
) -> DataFrame:
    """Merges request settings into the definition columns ``jvm_args`` and ``jvm_properties`` of the same row."""
    return df.withColumns(
        {
            "jvm_args": merged_args(F.col(args), F.col("jvm_args")),
            "jvm_properties": merged_properties(F.col("jvm_properties"), F.col(properties)),
        }
    )


def _leaves(col: Column, dtype: T.DataType, prefix: str) -> Iterator[Column]:
    """Map columns of dotted key to text, one per struct level; walks the schema, not the data."""
    if isinstance(dtype, T.StructType):
        for f in dtype:
            yield from _leaves(col.getField(f.name), f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
    elif isinstance(dtype, T.MapType):
        dotted = F.transform_keys(
            col.cast("map<string,string>"), lambda k, _: F.concat(F.lit(prefix + "." if prefix else ""), k)
        )
        yield F.coalesce(dotted, F.create_map().cast("map<string,string>"))
    else:
        yield F.map_filter(F.create_map(F.lit(prefix), col.cast("string")), lambda _, v: v.isNotNull())


def flatten_properties(df: DataFrame, col: str, name: str = "properties") -> DataFrame:
    """Nested properties (structs and maps of the declared schema) as one map with dotted keys."""
    maps = list(_leaves(F.col(col), df.schema[col].dataType, ""))
    return df.withColumn(name, F.map_concat(*maps) if maps else F.create_map().cast("map<string,string>"))


def render_properties(df: DataFrame, col: str, name: str = "rendered") -> DataFrame:
    """Map to ``-Dname=value`` strings, in key order."""
    pairs = F.array_sort(F.map_entries(col))
    return df.withColumn(name, F.transform(pairs, lambda e: F.concat(F.lit("-D"), e["key"], F.lit("="), e["value"])))


def qualify_uris(df: DataFrame, col: str, base_dir: str) -> DataFrame:
    """Adds ``uri`` (with a scheme) and ``file_name``."""
    return df.withColumns({"uri": qualified_uri(F.col(col), base_dir), "file_name": uri_file_name(F.col(col))})


def outcome_codes(df: DataFrame, col: str = "outcome") -> DataFrame:
    """Adds the response ``code`` of an outcome; anything unknown counts as a server error."""
    code = F.lit(UNEXPECTED_CODE)
    for outcome, number in OUTCOME_CODES.items():
        code = F.when(F.col(col) == outcome, number).otherwise(code)
    return df.withColumn("code", code)
