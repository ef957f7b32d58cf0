"""Column expressions over ids, storage paths and URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def deterministic_uuid(seed: Column) -> Column:
    """A uuid-shaped hash of ``seed``: the same input row gets the same id on every attempt of a task."""
    return F.regexp_replace(F.md5(seed), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def instance_id_parts(text: Column, mode: str = "suffix") -> tuple[Column, Column]:
    """(container, uuid) of an instance id; both null when the text is not an id.

    ``suffix`` takes the trailing uuid, so container names may hold dashes; ``first_dash`` cuts at the first dash.
    """
    if mode == "suffix":
        pattern = f"^(?s)(.*)-({UUID})$"
    elif mode == "first_dash":
        pattern = f"^([^-]*)-({UUID})$"
    else:
        raise ValueError(f"unknown mode {mode!r}")
    valid = text.rlike(pattern)
    return (
        F.when(valid, F.regexp_extract(text, pattern, 1)),
        F.when(valid, F.lower(F.regexp_extract(text, pattern, 2))),
    )


def path_tail(path: Column) -> Column:
    """Last element of a slash-separated path."""
    return F.element_at(F.split(path, "/"), -1)


def normalized_path(path: Column) -> Column:
    """Path with a leading slash and without surrounding blanks."""
    return F.trim(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def join_namespace(parent: Column, child: Column) -> Column:
    """Child namespace below ``parent`` without a doubled slash; an empty child leaves the parent as it is."""
    return (
        F.when(child == "", parent)
        .when(parent.endswith("/"), F.concat(parent, child))
        .otherwise(F.concat_ws("/", parent, child))
    )


def qualified_uri(uri: Column, base_dir: str) -> Column:
    """URI with a scheme: plain paths become ``file://``, relative ones below ``base_dir`` and not normalised."""
    base = base_dir if base_dir.endswith("/") else base_dir + "/"
    return (
        F.when(uri.rlike(SCHEME), uri)
        .when(uri.startswith("/"), F.concat(F.lit("file://"), uri))
        .otherwise(F.concat(F.lit("file://" + base), uri))
    )


def uri_file_name(uri: Column) -> Column:
    """File name part of a URI's path: no query, no fragment."""
    return F.regexp_extract(F.regexp_replace(uri, "[?#].*$", ""), "([^/]*)$", 1)
