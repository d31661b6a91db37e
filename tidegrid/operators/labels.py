"""Labels and aliases; samples are not touched."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidegrid.model import SeriesFrame, set_label


def alias(f: SeriesFrame, text: str) -> SeriesFrame:
    """Alias with {{.tag}} replaced by the tag's value, or by its name where it is missing."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*\.([^}\s]+)\s*\}\}", text):
        parts += [F.lit(text[at : m.start()]), F.coalesce(F.col("labels")[m[1]], F.lit(m[1]))]
        at = m.end()
    return f.with_meta(f.meta.withColumn("alias", F.concat(*parts, F.lit(text[at:]))))


def alias_by_tags(f: SeriesFrame, tags: list[str]) -> SeriesFrame:
    """Values of tags joined by a space; missing ones are skipped."""
    if not tags:
        raise ValueError("aliasByTags needs a tag")
    return f.with_meta(f.meta.withColumn("alias", F.concat_ws(" ", *[F.col("labels")[t] for t in tags])))


def show_tags(f: SeriesFrame, keys: bool = True, tags: list[str] | None = None) -> SeriesFrame:
    """Alias of `k:v k:v`, or of the values only; all tags in order of their names if none are given."""
    names = F.array(*[F.lit(t) for t in tags]) if tags else F.array_sort(F.map_keys("labels"))
    shown = F.filter(names, lambda k: F.col("labels")[k].isNotNull())
    text = F.transform(shown, lambda k: F.concat(k, F.lit(":"), F.col("labels")[k]) if keys else F.col("labels")[k])
    return f.with_meta(f.meta.withColumn("alias", F.array_join(text, " ")))


def tag_sub(f: SeriesFrame, tag: str, search: str, replacement: str) -> SeriesFrame:
    """Every match of search in tag replaced; $1 is a group of the match, \\1 of the first match in the tag, empty if it took no part. A group that search doesn't have is an error. A series without the tag stays as it is."""
    old = F.col("labels")[tag]
    try:
        groups = re.compile(search).groups
    except re.error:  # what only Java reads, Spark checks
        groups = 99
    parts, at = [], 0
    for m in re.finditer(r"\\(\d+)", replacement):
        if int(m[1]) > groups:
            raise ValueError(f"tagSub: {search} has no group {m[1]}")
        first = F.coalesce(F.regexp_extract(old, search, int(m[1])), F.lit(""))
        parts += [F.lit(replacement[at : m.start()]), F.regexp_replace(first, F.lit(r"([\\$])"), F.lit(r"\\$1"))]
        at = m.end()
    new = F.regexp_replace(old, F.lit(search), F.concat(*parts, F.lit(replacement[at:])))
    return f.with_meta(f.meta.withColumn("labels", F.when(old.isNotNull(), set_label(F.col("labels"), tag, new)).otherwise(F.col("labels"))))


def map_key(f: SeriesFrame, old: str, new: str) -> SeriesFrame:
    """Tag old renamed to new, which it overwrites; a series without old stays as it is."""
    moved = F.map_concat(F.map_filter(F.col("labels"), lambda k, _: (k != old) & (k != new)), F.create_map(F.lit(new), F.col("labels")[old]))
    tags = None if f.tags is None else tuple(new if t == old else t for t in f.tags if t != new or t == old)
    return f.with_meta(f.meta.withColumn("labels", F.when(F.col("labels")[old].isNotNull(), moved).otherwise(F.col("labels"))), tags=tags)
