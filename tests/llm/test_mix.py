import pytest
from pyspark.sql import functions as F

from tidegrid.llm.mix import Mix

T = "source string, target_share double, max_repeats int"


def docs(spark, sizes):
    rows, i = [], 0
    for source, words in sizes:
        for n in words:
            rows.append((i, None if n is None else " a" * n, source, "clash"))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string")


def test_shares_and_repeats(spark):
    d = docs(spark, [("big", [7] * 3000), ("small", [5] * 60), ("none", []), (None, [3] * 50), ("other", [9] * 10), ("blank", [0, None])])
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("absent", 0.1, 2), ("blank", 0.1, 3)], T)
    m = Mix(d, t, buckets=16)
    s = {r["source"]: r for r in m.shares().collect()}
    assert set(s) == {"big", "small", "absent", "blank"}
    # small is the tighter one: 300 tokens four times are 37.5 % of the rest
    assert s["small"]["tokens"] == 1200 and s["small"]["most_repeats"] == 4
    assert abs(s["big"]["tokens"] - 2000) <= 3.5 and s["big"]["most_repeats"] == 1
    assert abs(s["small"]["actual_share"] - 0.375) < 0.001 and s["absent"]["tokens"] == 0 and s["blank"]["tokens"] == 0
    rows = m.rows().collect()
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    assert {r["source"] for r in rows} <= {"big", "small", "blank"}


def test_total_tokens_epochs_and_rest(spark):
    d = docs(spark, [("a", [3, 1, 2, 4, 10]), ("b", [6, 6, 8])])
    m = Mix(d, spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], T), total_tokens=60, buckets=4)
    s = {r["source"]: r for r in m.shares().collect()}
    assert abs(s["a"]["tokens"] - 30) <= 5 and abs(s["b"]["tokens"] - 30) <= 4
    uses = m.rows().groupBy("doc_id", "source").agg(F.max("copy_no").alias("n")).collect()
    assert {r["n"] for r in uses} <= {1, 2}
    short = {r["source"]: r["tokens"] for r in Mix(d, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 9)], T), total_tokens=100, buckets=4).shares().collect()}
    assert short["a"] == 20 and abs(short["b"] - 50) <= 4


def test_order_is_random_but_fixed(spark):
    d = docs(spark, [("a", [1] * 400)])
    t = spark.createDataFrame([("a", 1.0, 1)], T)
    pick = lambda seed, parts: sorted(r["doc_id"] for r in Mix(d.repartition(parts), t, total_tokens=100, buckets=8, seed=seed).rows().collect())
    assert pick(1, 2) == pick(1, 5) != pick(2, 2)
    assert 90 <= len(pick(1, 2)) <= 110 and max(pick(1, 2)) > 300


def test_empty_and_bad_targets(spark):
    d = docs(spark, [("a", [5])])
    assert Mix(d.limit(0), spark.createDataFrame([("a", 1.0, 1)], T)).rows().count() == 0
    odd = spark.createDataFrame([(None, 0.5, 1), ("a", 0.0, 1), ("b", 0.5, 0)], T)
    s = Mix(d, odd).shares().collect()
    assert {(r["source"], r["tokens"], r["actual_share"]) for r in s} == {("a", 0, None), ("b", 0, None)}
    with pytest.raises(ValueError):
        Mix(d, odd, buckets=3)


def test_ranges_follow_the_number_of_documents(spark, monkeypatch):
    from tidegrid.llm import mix

    d = docs(spark, [("a", [2] * 600), ("b", [1] * 30)])
    t = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 9)], T)
    pick = lambda m: sorted((r["doc_id"], r["copy_no"]) for r in m.rows().collect())
    one = Mix(d, t, total_tokens=500)
    monkeypatch.setattr(mix, "RANGE_DOCS", 4)
    many = Mix(d, t, total_tokens=500)
    assert one.buckets == 16 and many.buckets == 256
    assert pick(one) == pick(many)
    assert many.sized.groupBy("source", "bucket").count().agg(F.max("count")).head()[0] < 20
