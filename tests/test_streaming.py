import json

from pyspark.sql import functions as F

from tidegrid.sources.output import read_blocks
from tidegrid.streaming import ingest

MIN = 60_000


def doc(labels, ts, value, ref=None):
    return json.dumps({"labels": labels, "timestamp": ts, "value": value, **({"reference": ref} if ref else {})})


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_ingest_retention_and_compaction(spark, tmp_path):
    src, out, done = tmp_path / "in", str(tmp_path / "blocks"), str(tmp_path / "compact")
    write(src, "1.json", [doc("a 1 b 2", 10 * MIN, 1), doc("b 2 a 1", 10 * MIN, "1.0"), doc("a 1 b 2", 130 * MIN, "+Inf"), doc(None, 5 * MIN, 2, 7), doc(None, 5 * MIN, 2), doc("a 1 b 2", 9 * MIN, "bad"), "{broken"])
    for _ in range(2):  # a second start finds nothing new
        q = ingest.start_ingest(ingest.in_time(ingest.documents(spark.readStream.text(str(src)))), out, str(tmp_path / "ck"), trigger={"availableNow": True})
        q.awaitTermination(120)
    assert ingest.blocks(spark, out) == [0, 120 * MIN]
    rows = spark.read.parquet(out).collect()
    assert sorted((r["series_key"][0], r["ts"], r["value"]) for r in rows) == [("L", 10 * MIN, 1.0), ("L", 130 * MIN, float("inf")), ("R", 5 * MIN, 2.0)]
    assert read_blocks(spark, out, 6 * MIN, 100 * MIN).count() == 1
    ingest.compact(spark, out, done, files=1)
    assert spark.read.parquet(done).count() == 3
    assert ingest.retain(spark, done, ingest.BLOCK, now_ms=250 * MIN) == [0]
    assert ingest.blocks(spark, done) == [120 * MIN]


def test_reject_late_is_exact(spark, tmp_path):
    src = tmp_path / "in"
    for i, batch in enumerate([[(0, 100), (1, 70), (2, 79), (3, 80)], [(4, 81), (5, 200), (6, 150)], [(7, 179), (8, 180)]]):
        write(src, f"{i}.json", [json.dumps({"seq": s, "ts": t * MIN}) for s, t in batch])
    stream = spark.readStream.schema("seq long, ts long").option("maxFilesPerTrigger", 1).json(str(src)).withColumns({"series_key": F.lit("k"), "value": F.lit(1.0)})
    q = ingest.reject_late(stream, 20 * MIN, shards=1).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["seq"] for r in spark.table("kept").collect()) == [0, 3, 4, 5, 8]


def test_chunks_close_with_the_watermark(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "0.json", [doc("a 1", 1 * MIN, 1), doc("a 1", 19 * MIN, 5), doc("a 1", 21 * MIN, 3)])
    write(src, "1.json", [doc("a 1", 90 * MIN, 3)])
    stream = ingest.documents(spark.readStream.option("maxFilesPerTrigger", 1).text(str(src)))
    q = ingest.chunks(stream).writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["chunk_start"], r["n"], r["first"], r["last"]) for r in spark.table("chunks").collect())
    assert got == [(0, 2, 1.0, 5.0), (20 * MIN, 1, 3.0, 3.0)]


def test_compaction_leaves_other_blocks_of_its_target(spark, tmp_path):
    src, out = str(tmp_path / "blocks"), str(tmp_path / "compact")
    rows = [("a", t * MIN, float(t), t, t * MIN // ingest.BLOCK * ingest.BLOCK) for t in (0, 0, 130, 250)]
    spark.createDataFrame(rows, "series_key string, ts long, value double, seq long, block_start long").write.partitionBy("block_start").parquet(src)
    ingest.compact(spark, src, out, [0])
    ingest.compact(spark, src, out, [120 * MIN])
    ingest.compact(spark, src, out, [0])
    assert sorted(r["ts"] for r in spark.read.parquet(out).collect()) == [0, 130 * MIN]


def test_the_registry_gets_or_creates_series_and_drops_dead_ones(spark, tmp_path):
    src, at, ck = tmp_path / "in", str(tmp_path / "catalog"), str(tmp_path / "ck")

    def run():
        ingest.registry(ingest.documents(spark.readStream.text(str(src))), at, ck, {"availableNow": True}).awaitTermination(120)
        return {r["series_key"]: (r["ref"], r["first_ts"] // MIN, r["last_ts"] // MIN) for r in ingest.series(spark, at).collect()}

    write(src, "0.json", [doc("a 1 b 2", 10 * MIN, 1), doc("b 2 a 1", 30 * MIN, 1), doc(None, 5 * MIN, 2, 7)])
    one = run()
    assert sorted(x[1:] for x in one.values()) == [(5, 5), (10, 30)]
    write(src, "1.json", [doc("b 2 a 1", 2 * MIN, 1), doc("c 3", 50 * MIN, 1)])
    two = run()
    assert len(two) == 3 and all(two[k][0] == one[k][0] for k in one) and sorted(x[1:] for x in two.values()) == [(2, 30), (5, 5), (50, 50)]
    ingest.drop_series(spark, at, 20 * MIN)
    assert sorted(x[1:] for x in [(r["ref"], r["first_ts"] // MIN, r["last_ts"] // MIN) for r in ingest.series(spark, at).collect()]) == [(2, 30), (50, 50)]
    write(src, "2.json", [doc(None, 60 * MIN, 2, 7)])
    assert run()["R7"] == (one["R7"][0], 60, 60)
    assert len(ingest.series(spark, at).collect()) == 3


def test_tiers():
    h = 3_600_000
    assert ingest.tiers(20 * h, 2 * h) == [2 * h] and ingest.tiers(200 * h, 2 * h) == [2 * h, 6 * h, 18 * h]
    assert ingest.tiers(None, 2 * h)[-1] == 486 * h and ingest.tiers(10_000 * h, 2 * h)[-1] == 744 * h
    steps = ingest.tiers(200 * h, 2 * h)
    assert ingest.tier_plan([0, 2 * h, 4 * h, 6 * h], steps) == [0, 2 * h, 4 * h]
    assert ingest.tier_plan([0, 2 * h, 4 * h], steps) == [] == ingest.tier_plan([], steps)
    assert ingest.tier_plan([-6 * h, -2 * h, 0, 12 * h], steps) == [-6 * h, -2 * h]
