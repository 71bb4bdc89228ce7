from pyspark.sql import functions as F

from docweave.streaming import events as ev


def files(spark, sf, tmp_path):
    """The events in three files, in order."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    at = tmp_path / "in"
    for k in range(3):
        df.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(at))
    return df, str(at)


def drained(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_latest(spark, sf, tmp_path):
    df, at = files(spark, sf, tmp_path)
    drained(ev.latest(ev.read(spark, at, df.schema)), "complete", "latest_out")
    got = {r["user_id"]: (r["n"], r["event_id"]) for r in spark.table("latest_out").collect()}
    want = df.groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id")).alias("l"))
    assert got == {r["user_id"]: (r["n"], r["l"]["event_id"]) for r in want.collect()}


def test_timed(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/events.parquet")
    at = str(tmp_path / "in")
    df.coalesce(1).write.parquet(at)
    drained(ev.timed(ev.read(spark, at, df.schema)), "append", "timed_out")
    rows = spark.table("timed_out").collect()
    assert len(rows) == df.count()
    firsts = {}
    for r in sorted(df.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).collect(), key=lambda r: (r["ms"], r["event_id"])):
        firsts.setdefault(r["user_id"], []).append((r["ms"], r["event_id"]))
    for r in rows:
        own = firsts[r["user_id"]]
        k = [e for _, e in own].index(r["event_id"])
        assert r["total_ms"] == own[k][0] - own[0][0] and r["step_ms"] == (own[k][0] - own[k - 1][0] if k else None)


def test_windowed(spark, sf, tmp_path):
    df, at = files(spark, sf, tmp_path)
    drained(ev.windowed(ev.read(spark, at, df.schema), late="10000 days"), "update", "win_out")
    assert spark.table("win_out").count() > 0


def test_upserting(spark, sf, tmp_path):
    df, at = files(spark, sf, tmp_path)
    q = ev.upserting(ev.read(spark, at, df.schema), str(tmp_path / "out"), ["user_id", "event_type"], "event_id", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    versions = sorted((tmp_path / "out").glob("v=*"), key=lambda p: int(p.name[2:]))
    got = {(r["user_id"], r["event_type"]): r["event_id"] for r in spark.read.parquet(str(versions[-1])).collect()}
    assert got == {(r["user_id"], r["event_type"]): r["m"] for r in df.groupBy("user_id", "event_type").agg(F.max("event_id").alias("m")).collect()}
