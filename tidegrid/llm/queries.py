"""Queries p1, p4, p6, p7 and p8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm import distinct, encode, mix, quantiles, split
from tidegrid.queries.usable_sql import USABLE
from tidegrid.sources.documents import usable_samples
from tidegrid.sources.tables import table

PERCENTILES = (1.0, 5.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0, 99.9)
_LABELS = ("service", "region", "status")


def _samples(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    catalog = table(spark, d, "series_catalog")
    label = {c: F.col("labels")[c] for c in ("service", "region", "status", "pod")}
    series = catalog.select("series_ref", "metric_name", "labels", "min_ts", "max_ts").withColumns({k: v for k, v in label.items() if k in keep or "group" in keep})
    if "group" in keep:
        series = series.withColumn("group", F.to_json(F.struct("metric_name", *_LABELS)))
    return usable_samples(table(spark, d, "tsdb_documents"), series, keep)


def _sets(g: str) -> Column:
    """The groups that a finest group belongs to: its metric, and its metric with each label."""
    return F.array(F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("label")), *[F.struct(F.lit(c).alias("dimension"), F.col(f"{g}.{c}").alias("label")) for c in _LABELS])


_P1_KEYS = ["metric_name", "dimension", "label"]


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the usable values of each metric, and of each metric with each service, region and status: sketches of the finest groups, merged upwards."""
    fine = quantiles.merge_sketches(quantiles.merge_sketches(quantiles.sketches(_samples(spark, d, ["group"]), "group", "value"), ["group", "part"]), ["group"])
    g = F.from_json("group", "metric_name string, service string, region string, status string")
    up = fine.withColumn("g", g).select("group", F.col("g.metric_name").alias("metric_name"), F.explode(_sets("g")).alias("s"), "sketch").select("group", "metric_name", "s.*", "sketch")
    return quantiles.percentiles(quantiles.merge_spread(up, _P1_KEYS, ["group"]), _P1_KEYS, PERCENTILES)


def p1_within(spark: SparkSession, d: str) -> DataFrame:
    """Of each group the number of values and of NaN, and whether the exact rank of every percentile given lies within its stated error."""
    answers = p1_percentiles(spark, d)
    by_group = answers.groupBy(*_P1_KEYS).agg(F.array_sort(F.collect_list(F.struct("p", "value", "rank_error"))).alias("a"), F.max("n").alias("n"), F.max("n_nan").alias("n_nan"))
    s = _samples(spark, d, ["metric_name", *_LABELS]).where(~F.isnan("value")).select("metric_name", F.struct(*_LABELS).alias("g"), "value").groupBy("metric_name", "g", "value").agg(F.count(F.lit(1)).alias("m"))
    s = s.select("metric_name", F.explode(_sets("g")).alias("s"), "value", "m").select("metric_name", "s.*", "value", "m")
    keys = [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in _P1_KEYS]
    both = s.alias("s").join(by_group.alias("b"), keys[0] & keys[1] & keys[2])
    below = [F.sum(F.when(F.col("s.value") < F.col("b.a")[i]["value"], F.col("m")).otherwise(0)).alias(f"l{i}") for i in range(len(PERCENTILES))]
    upto = [F.sum(F.when(F.col("s.value") <= F.col("b.a")[i]["value"], F.col("m")).otherwise(0)).alias(f"h{i}") for i in range(len(PERCENTILES))]
    ranks = both.groupBy(*[F.col(f"b.{k}").alias(k) for k in _P1_KEYS]).agg(F.first("b.a").alias("a"), F.first("b.n").alias("n"), F.first("b.n_nan").alias("n_nan"), *below, *upto)

    def fits(i: int) -> Column:
        off = F.lit(PERCENTILES[i] / 100), F.col("a")[i]["rank_error"] + 1 / F.col("n")
        return (F.col(f"l{i}") / F.col("n") <= off[0] + off[1]) & (F.col(f"h{i}") / F.col("n") >= off[0] - off[1])

    within = fits(0)
    for i in range(1, len(PERCENTILES)):
        within = within & fits(i)
    return ranks.select(*_P1_KEYS, "n", "n_nan", within.alias("within"))


def p1_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each metric by UTC day, and over all days from the same daily sketches; day_utc is null for the latter."""
    day = F.date_format(F.timestamp_millis("sample_ts"), "yyyy-MM-dd")
    s = _samples(spark, d, ["metric_name"]).select(F.concat_ws(" ", day, "metric_name").alias("group"), "value")
    daily = quantiles.merge_sketches(quantiles.merge_sketches(quantiles.sketches(s, "group", "value"), ["group", "part"]), ["group"])
    up = daily.select("group", F.substring_index("group", " ", -1).alias("metric_name"), F.explode(F.array(F.substring_index("group", " ", 1), F.lit(None).cast("string"))).alias("day_utc"), "sketch")
    keys = ["metric_name", "day_utc"]
    return quantiles.percentiles(quantiles.merge_spread(up, keys, ["group"]), keys, PERCENTILES)


def _ids(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d, ["metric_name", "service", "region", "pod"])
    day = F.date_format(F.timestamp_millis("sample_ts"), "yyyy-MM-dd")
    both = F.array(F.struct(F.lit("series").alias("what"), F.concat(F.lit("s"), F.col("series_ref").cast("string")).alias("id")), F.struct(F.lit("pod").alias("what"), F.concat(F.lit("p"), "pod").alias("id")))
    return s.select(day.alias("day_utc"), "metric_name", "service", "region", F.explode(both).alias("x")).select("day_utc", "metric_name", "service", "region", "x.what", "x.id")


def _matrices(spark: SparkSession, d: str) -> DataFrame:
    return distinct.matrices(_ids(spark, d), ["day_utc", "metric_name", "service", "region", "what"], "id")


_DIMS = ["day_utc", "metric_name", "service", "region"]
_SETS = {"day": _DIMS[:1], "day_metric": _DIMS[:2], "day_service": ["day_utc", "service"], "day_region": ["day_utc", "region"], "day_service_region": ["day_utc", "service", "region"], "all": [], "metric": ["metric_name"], "service_region": ["service", "region"]}
_P4_KEYS = ["grouping", *_DIMS, "what"]


def _groupings() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("grouping"), *[F.col(c) if c in keep else F.lit(None).cast("string").alias(c) for c in _DIMS]) for n, keep in _SETS.items()])


def p4_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct series and pods per day, per day with metric, service, region and service with region, and over all days: unions of one set of matrices."""
    parts = _matrices(spark, d).select(F.explode(_groupings()).alias("g"), "what", "bucket", "bits").select("g.*", "what", "bucket", "bits")
    return distinct.estimates(distinct.merged(parts, _P4_KEYS), _P4_KEYS)


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each grouping: its groups, the sum of the exact counts, and whether at least 98 % of the intervals hold the exact count."""
    once = _ids(spark, d).where("id is not null").distinct().select(F.explode(_groupings()).alias("g"), "what", "id").select("g.*", "what", "id")
    exact = once.groupBy(*_P4_KEYS).agg(F.count_distinct("id").alias("exact"))
    both = exact.select(*_P4_KEYS, "exact", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    both = both.unionByName(p4_distinct(spark, d).select(*_P4_KEYS, F.lit(None).cast("long").alias("exact"), "low", "high"))
    both = both.groupBy(*_P4_KEYS).agg(F.max("exact").alias("exact"), F.max("low").alias("low"), F.max("high").alias("high"))
    held = F.coalesce((F.col("exact") >= F.col("low") - 1e-6) & (F.col("exact") <= F.col("high")), F.lit(False))
    return both.groupBy("grouping", "what").agg(F.count(F.lit(1)).alias("groups"), F.sum("exact").alias("total"), (F.avg(held.cast("double")) >= 0.98).alias("covered"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encoded(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The digest of every document's text as it comes back from its token ids; null texts come back empty."""
    ids = encode.encoded(table(spark, d, "documents"))
    return encode.decoded(ids).select("doc_id", F.md5("text").alias("digest"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document in the largest mix that meets the target shares."""
    return mix.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).rows()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that mix reaches."""
    return mix.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares()


def p7_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Of each target source: its documents, and whether its use is within half of its largest document of the budget, with no document used too often, and its share within a hundredth of its target among the sources that have tokens."""
    m = mix.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    largest = m.sized.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    r = m.shares().join(largest, "source", "left").join(table(spark, d, "mix_targets").select("source", "max_repeats"), "source")
    wanted = F.when(F.col("available_tokens") > 0, F.col("target_share"))
    wanted = F.coalesce(wanted / F.sum(wanted).over(Window.partitionBy(F.lit(1))), F.lit(0.0))  # as many rows as there are targets
    return r.select(
        "source",
        F.col("available_docs").alias("docs"),
        (F.abs(F.col("tokens") - F.col("budget_tokens")) <= F.coalesce("largest", F.lit(0)) / 2 + 1).alias("in_budget"),
        (F.col("most_repeats") <= F.col("max_repeats")).alias("in_repeats"),
        (F.abs(F.coalesce("actual_share", F.lit(0.0)) - wanted) <= F.greatest(F.lit(0.01), F.coalesce("largest", F.lit(0)) / F.greatest(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(1)))).alias("on_target"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be cut."""
    return split.split_documents(table(spark, d, "documents")).where("piece_no = 0").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized document."""
    return split.split_documents(table(spark, d, "documents"))


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of each document: its length in characters, how many characters its pieces hold without their overlaps (those of an uncut document being its own), and whether all pieces keep to the limit and share what they must."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    after = Window.partitionBy("doc_id").orderBy("piece_no")
    p = p8_pieces(spark, d).select("doc_id", "piece_no", "n_tokens", "overlap_tokens", "start_char", "end_char", F.lag("end_char").over(after).alias("before"))
    ok = (F.col("n_tokens") <= split.LIMIT) & ((F.col("piece_no") == 0) | F.col("overlap_tokens").between(split.OVERLAP, split.OVERLAP + 3) & (F.col("start_char") <= F.col("before")))
    p = p.groupBy("doc_id").agg(F.sum(F.col("end_char") - F.coalesce("before", F.lit(0))).alias("covered"), F.min(ok).alias("ok"))
    return docs.join(p, "doc_id", "left").select("doc_id", "n", F.coalesce("covered", "n").alias("covered"), F.coalesce("ok", F.lit(True)).alias("kept"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_days, p1_within, p4_distinct, p4_coverage, p6_ids, p6_round_trip, p7_mix, p7_shares, p7_budgets, p8_found, p8_pieces, p8_whole)}

_DAY = "strftime(make_timestamp(sample_ts * 1000), '%Y-%m-%d')"
_FINE = f"fine AS (SELECT DISTINCT {_DAY} AS day_utc, metric_name, labels['service'] AS service, labels['region'] AS region, unnest(['series', 'pod']) AS what, unnest(['s' || series_ref, 'p' || labels['pod']]) AS id FROM usable)"


def _exact(name: str, keep: list[str]) -> str:
    own = ", ".join(c if c in keep else f"NULL AS {c}" for c in _DIMS)
    return f"SELECT '{name}' AS grouping, {own}, what, count(DISTINCT id) AS n FROM fine WHERE id IS NOT NULL GROUP BY ALL"


#: Sketches, token ids and what follows from them are beyond SQL; what must hold of them is not. Their tests compare with brute force.
SQL: dict[str, str] = {
    "p1_within": f"""WITH {USABLE}, sets AS (SELECT metric_name, 'all' AS dimension, NULL AS label, value FROM usable
        {" ".join(f"UNION ALL SELECT metric_name, '{c}', labels['{c}'], value FROM usable" for c in _LABELS)})
        SELECT metric_name, dimension, label, count(*) FILTER (NOT isnan(value)) AS n, count(*) FILTER (isnan(value)) AS n_nan, true AS within FROM sets GROUP BY ALL HAVING n > 0""",
    "p4_coverage": f"WITH {USABLE}, {_FINE}, e AS ({' UNION ALL '.join(_exact(n, k) for n, k in _SETS.items())}) SELECT grouping, what, count(*) AS groups, sum(n)::BIGINT AS total, true AS covered FROM e GROUP BY ALL",
    "p6_round_trip": "SELECT doc_id, md5(COALESCE(text, '')) AS digest FROM documents",
    "p7_budgets": "SELECT source, (SELECT count(*) FROM documents d WHERE d.source = t.source) AS docs, true AS in_budget, true AS in_repeats, true AS on_target FROM mix_targets t",
    "p8_whole": "SELECT doc_id, length(COALESCE(text, '')) AS n, length(COALESCE(text, '')) AS covered, true AS kept FROM documents",
}
