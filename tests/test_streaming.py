from pyspark.sql import functions as F

from lodestone.operators import scanners
from lodestone.sources.corpus import documents_as_files
from lodestone.streaming import flows


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def copy(spark, sf001, tmp_path, name, parts=3):
    df = spark.read.parquet(f"{sf001}/{name}.parquet")
    path = str(tmp_path / name)
    df.repartition(parts).write.parquet(path)
    return df, flows.read_stream(spark, path, df, files_per_trigger=1)


def test_stream_of_findings_equals_batch(spark, sf001, tmp_path):
    docs, stream = copy(spark, sf001, tmp_path, "documents")
    got = run(flows.scan_stream(stream, ["secrets", "todos"]), "found")
    want = scanners.rule_scans(documents_as_files(docs), ["secrets", "todos"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windows_equal_batch_within_the_watermark(spark, sf001, tmp_path):
    events, stream = copy(spark, sf001, tmp_path, "events")
    got = run(flows.windowed_counts(stream, late="3650 days"), "windows", "complete")
    want = flows.windowed_counts(events)
    key = lambda rows: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in rows)
    assert key(got.collect()) == key(want.collect())


def test_breaker_keeps_state(spark, sf001, tmp_path):
    events, stream = copy(spark, sf001, tmp_path, "events", 1)
    got = run(flows.breaker_stream(stream, 2), "breaker", "update").toPandas()
    runs = {}
    for r in events.orderBy("ts", "event_id").collect():
        runs[r.user_id] = runs.get(r.user_id, 0) + 1 if r.event_type == "error" else 0
    assert dict(zip(got.user_id, got.run)) == runs and (got.open == (got.run >= 2)).all()
    from lodestone.operators import state

    got = run(flows.breaker_stream(stream, 1, 5_000_000), "cooling", "update").toPandas().set_index("user_id")
    want = state.breaker(events.withColumn("failed", F.col("event_type") == "error"), "user_id", 1, 5_000_000).toPandas().set_index("user_id")
    assert got.refused.to_dict() == want.n_refused.to_dict() and want.n_refused.sum() > 0 and got.open.to_dict() == want.open_at_end.to_dict()


def test_upsert_table(spark, sf001, tmp_path):
    events, stream = copy(spark, sf001, tmp_path, "events")

    def merge(old, new):
        return old.unionByName(new).dropDuplicates(["event_id"])

    q = flows.upsert_table(stream, str(tmp_path / "t"), str(tmp_path / "c"), merge)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t/v2")).count() == events.count()
