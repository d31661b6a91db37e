"""Ingest documents and the series catalog: canonical labels, values sent as text, usable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.session import checkpointed, small_side

#: Separators of the canonical form; no label holds these control characters.
PAIR, ENTRY = "\u0001", "\u0002"
DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def canonical_text(labels: Column) -> Column:
    """One text per set of label pairs, from the ingest form `k v k v`: sorted, without repeats.

    Single spaces separate, so two spaces in a row or a trailing one mean an empty value. Null stays null, "" is the empty set, and an odd last token stays without a value, so that it equals no catalog entry.
    """
    marked = F.regexp_replace(labels, "([^ ]*) ([^ ]*)( |$)", f"$1{PAIR}$2{ENTRY}")
    return F.array_join(F.sort_array(F.array_distinct(F.array_remove(F.split(marked, ENTRY), ""))), ENTRY)


def canonical_map(labels: Column) -> Column:
    """The same text from a map; a null value counts as empty."""
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit(PAIR), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.sort_array(F.array_distinct(pairs)), ENTRY)


def parsed_value(number: Column, text: Column) -> Column:
    """number, else text read as a decimal number or as +Inf/-Inf with blanks around it allowed; null if unreadable. NaN as a number is a value; as text it is unreadable."""
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.coalesce(
        number,
        F.when(text.rlike(DECIMAL), bare.try_cast("double")).when(bare == "+Inf", F.lit(float("inf"))).when(bare == "-Inf", F.lit(float("-inf"))),
    )


def usable_samples(documents: DataFrame, series: DataFrame, keep: list[str], by_text: bool = True) -> DataFrame:
    """Usable samples: (row_id, series_ref, sample_ts, value) and the columns `keep` of series.

    A document belongs to the series with its set of labels, or, if labels is null, with its series_ref; it needs a readable value and a time within the life of the series, both ends included. Late and repeated rows stay. A document that names neither, or nothing known, is left out, as is one without a time.

    series: series_ref, labels, min_ts, max_ts and the columns of keep, already filtered to the series that are wanted. Other columns of either table are dropped first, so clashing names do no harm. Both ways to name a series become one 128-bit key, on which documents are joined once; the catalog side is broadcast only if a count proves it small.

    Working out a set of labels costs more than all else, and texts come back often. With by_text each distinct text is worked out once, for which the column of labels is read on its own first, and what the texts name is written to the checkpoint folder: for whole tables. Without it, documents are read once and each text is worked out: for selections.
    """
    names = [c for c in dict.fromkeys(["series_ref", "min_ts", "max_ts", *keep])]
    by_labels = F.concat(F.lit("L"), canonical_map("labels")).alias("_key")
    by_ref = F.concat(F.lit("R"), F.col("series_ref").cast("string"))
    sets = series.select(*names, by_labels).where("_key is not null").select(*names, *_hashes(F.col("_key")))
    refs = series.select(*names, by_ref.alias("_key")).where("_key is not null").select(*names, *_hashes(F.col("_key")))
    if by_text:
        texts = documents.select("labels").where("labels is not null").distinct()
        texts = texts.select(F.concat(F.lit("L"), "labels").alias("_text"), *_hashes(F.concat(F.lit("L"), canonical_text(F.col("labels")))))
        named = texts.join(sets, ["_k1", "_k2"]).select(*names, *_hashes(F.col("_text")))
        own, text = checkpointed(named.unionByName(refs)), F.col("labels")
    else:
        own, text = sets.unionByName(refs), canonical_text(F.col("labels"))
    docs = documents.select(
        "row_id",
        "sample_ts",
        parsed_value(F.col("sample_value"), F.col("value_text")).alias("value"),
        F.coalesce(F.concat(F.lit("L"), text), by_ref).alias("_key"),
    ).where("value is not null and sample_ts is not null")
    # No filter on _key: it would be pushed below the projection and work the key out once more. A null key's hash is no key of the catalog.
    docs = docs.select("row_id", "sample_ts", "value", *_hashes(F.col("_key")))
    joined = docs.join(small_side(own), ["_k1", "_k2"]).where("sample_ts between min_ts and max_ts")
    return joined.select("row_id", "sample_ts", "value", *names)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("_k1"), F.xxhash64(F.lit(1), key).alias("_k2")]


def series_with_metric(catalog: DataFrame, metric_info: DataFrame) -> DataFrame:
    """The catalog with grid_ms, metric_kind and limits of each series' metric; NaN limits become null. metric_info has a row per metric; Spark broadcasts it if it is under its own threshold."""
    info = metric_info.select("metric_name", "metric_kind", "grid_ms", F.nanvl("low_limit", F.lit(None).cast("double")).alias("low_limit"), F.nanvl("high_limit", F.lit(None).cast("double")).alias("high_limit"))
    return catalog.select("series_ref", "metric_name", "labels", "min_ts", "max_ts").join(info, "metric_name")
