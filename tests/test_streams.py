from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postloom.streaming import streams

T0 = datetime(2024, 1, 1)


def streamed(spark, tmp_path, batches, schema, f, mode="append"):
    """Rows that a stream gives for batches of rows, each a file that arrives after the last."""
    src = str(tmp_path / "in")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        if not k:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            q = f(stream).writeStream.outputMode(mode).format("memory").queryName("out_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
    q.stop()
    return spark.table("out_rows").collect()


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def test_once_per_window(spark, tmp_path):
    got = streamed(spark, tmp_path, [[("a", at(0)), ("a", at(1)), ("b", at(2))], [("a", at(100))]], "key string, ts timestamp", streams.once_per_window)
    assert sorted((r.key, r.ts) for r in got) == [("a", at(0)), ("b", at(2))]


def test_served_window_does_not_slide(spark, tmp_path):
    got = streamed(spark, tmp_path, [[("a", at(0)), ("a", at(50))], [("a", at(90))], [("a", at(130)), ("b", at(131))]], "key string, ts timestamp", lambda s: streams.served(s, 100))
    assert sorted((r.key, r.ts, r.served_from) for r in got) == [("a", at(0), at(0)), ("a", at(50), at(0)), ("a", at(90), at(0)), ("a", at(130), at(130)), ("b", at(131), at(131))]


def test_throttle_on_a_stream(spark, tmp_path):
    rows = [[(1, at(0), "x"), (1, at(0.5), "y"), (1, at(1.2), "y"), (2, at(0), "x")], [(1, at(5), "y"), (1, at(6), "z")]]
    got = streamed(spark, tmp_path, rows, "job_id long, ts timestamp, counters string", streams.throttled)
    assert sorted((r.job_id, r.ts, r.counters) for r in got) == [(1, at(0), "x"), (1, at(1.2), "y"), (1, at(6), "z"), (2, at(0), "x")]


def test_cap(spark, tmp_path):
    rows = [[("s", 1, 4), ("t", 1, 0)], [("s", 2, 9), ("t", 2, 0)], [("s", 3, 1), ("t", 3, 0)]]
    got = streamed(spark, tmp_path, rows, "source string, round long, items long", lambda s: streams.capped(s, 10))
    assert sorted((r.source, r.round, r.taken, r.stop_reason or "") for r in got) == [("s", 1, 4, ""), ("s", 2, 6, "item_cap"), ("t", 1, 0, ""), ("t", 2, 0, ""), ("t", 3, 0, "stale")]


def test_rates_and_alerts(spark):
    rows = [(at(60 * m + s), "/a", m >= 6 and s % 2 == 0, 1.0) for m in range(20) for s in range(0, 60, 10)]
    out = streams.rates(spark.createDataFrame(rows, "ts timestamp, path string, failed boolean, value double"))
    assert out.where(F.col("start") == at(0)).first()["rate"] == pytest.approx(0.1)
    assert streams.alerts(out).agg(F.min("start")).first()[0] >= at(360)


def test_live_jobs_are_a_change_feed(spark, tmp_path):
    schema = "job_id long, source_id long, seq long, " + ", ".join(f"{c} long" for c in streams.COUNTERS)
    src, table = str(tmp_path / "p"), str(tmp_path / "t")
    row = lambda job, source, seq, n: (job, source, seq, n, n, 0, 0, 0)
    batches = [[row(1, 1, 1, 5), row(1, 2, 1, 1), row(1, 1, 0, 99)], [row(1, 1, 2, 9)], [row(1, 1, 1, 7), row(2, 1, 1, 3)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        streams.live_jobs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), table, str(tmp_path / "c1")).awaitTermination()
        fed = spark.read.parquet(table)
        assert fed.count() == (2, 3, 4)[k]  # what a batch changed, and no more
        every = [r for b in batches[: k + 1] for r in b]
        latest = lambda df: sorted(map(tuple, streams.latest_counters(df).collect()))
        assert latest(fed) == latest(spark.createDataFrame(every, schema))


def test_state_of_silent_keys_goes(spark, tmp_path):
    """Each batch has keys of its own; state is of the keys within reach of the watermark, and rows are as the table's."""
    def run(name, schema, rows_of, f, columns):
        src = str(tmp_path / name)
        batches, sizes = [rows_of(k) for k in range(6)], []
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            if not k:
                q = f(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-log")).start()
            q.processAllAvailable()
            sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        q.stop()
        got = sorted(map(repr, spark.table(name).select(*columns).collect()))
        whole = f(spark.createDataFrame([r for b in batches for r in b], schema)).select(*columns)
        assert got == sorted(map(repr, whole.collect()))
        return sizes

    hour = 3600
    sizes = run("visits_of_new_keys", "key string, ts timestamp", lambda k: [(f"k{k}_{j}", at(k * hour + i)) for j in range(20) for i in (0, 5, 70)], lambda s: streams.served(s, 60), ["key", "ts", "served_from", "first"])
    assert sizes[-1] <= sizes[2]
    progress = lambda k: [(100 * k + j, at(k * hour + i), c) for j in range(20) for i, c in ((0, "a"), (3, "a"), (4, "b"))] + [(7, at(k * hour + 50), "a")]
    sizes = run("progress_of_new_jobs", "job_id long, ts timestamp, counters string", progress, lambda s: streams.throttled(s, 1, 900), ["job_id", "ts", "counters"])
    assert sizes[-1] <= sizes[2]


def test_ingest_and_what_a_store_reads(spark, tmp_path):
    from postloom.sources.store import PostStore

    schema, src, path = "job_id long, source_id long, dedup_key string, ord long", str(tmp_path / "q"), str(tmp_path / "s")
    for rows in [[(1, 1, "a", 1), (1, 1, "a", 2), (1, 2, "a", 3)], [(1, 1, "a", 4), (1, 1, "b", 5)], [(1, None, "a", 6), (1, 3, None, 7)], [(1, None, "a", 8)]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        streams.ingest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), path, str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.ord for r in PostStore(spark, path).read().collect()) == [1, 3, 5, 6, 7, 8]

    store = PostStore(spark, str(tmp_path / "large"), buckets=16)
    posts = lambda sources, keys: spark.createDataFrame([(1, s, f"k{k}", 1000 * s + k) for s in sources for k in keys], schema)
    for k in range(3):
        store.append(posts(range(40), range(k * 20, k * 20 + 25)), k)
    assert store.read().count() == 40 * 65  # five keys of a batch are of the one before
    store.append(posts(range(40), range(40, 65)), 2)
    assert store.read().count() == 40 * 65  # again
    one = posts([7], range(60, 70))
    assert sorted(r.ord for r in store.new_posts(one).collect()) == [7065, 7066, 7067, 7068, 7069]
    read = []
    whole = store.stored_keys
    store.stored_keys = lambda buckets, before=None: read.append(buckets) or whole(buckets, before)
    assert store.new_posts(one).count() == 5 and len(read) == 1 and len(read[0]) == 1
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(whole(read[0])) < files(store.read()) / 4
    assert store.new_posts(posts([7], range(500, 600))).count() == 100 and len(read) == 1  # filters alone: no post was read
    store.drop()


def test_rules_on_a_table_are_held_across_batches_and_reset_at_keys(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = [(key, at(10 * k)) for key in ("a", None, "b") for k in range(7)]
        got = streams.served(spark.createDataFrame(rows, "key string, ts timestamp"), 25).collect()
        for key in ("a", None, "b"):
            mine = sorted((r.ts, r.served_from, r.first) for r in got if r.key == key)
            assert mine == [(at(10 * k), at(30 * (k // 3)), k % 3 == 0) for k in range(7)]
        rounds = [("s", k, 3) for k in range(9)] + [("t", k, 0) for k in range(5)] + [("u", 0, 50)]
        cut = streams.capped(spark.createDataFrame(rounds, "source string, round long, items long"), 10).collect()
        assert sorted((r.source, r.round, r.taken, r.stop_reason or "") for r in cut) == [
            ("s", 0, 3, ""), ("s", 1, 3, ""), ("s", 2, 3, ""), ("s", 3, 1, "item_cap"), ("t", 0, 0, ""), ("t", 1, 0, ""), ("t", 2, 0, "stale"), ("u", 0, 10, "item_cap"),
        ]
        assert streams.throttled(spark.createDataFrame([], "job_id long, ts timestamp, counters string")).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_percentiles_of_a_table_are_exact(spark):
    at = datetime(2024, 1, 1, 0, 4, 30)
    rows = [(at, "/a", k % 10 == 0, float(k) if k else None) for k in range(101)] + [(at, "/a", False, 3.0)] * 100 + [(datetime(2024, 1, 2), "/a", True, None)]
    out = streams.rates(spark.createDataFrame(rows, "ts timestamp, path string, failed boolean, value double"), None)
    got = {(r.rate, r.failure_share, r.p95) for r in out.collect()}
    assert got == {(201 / 300, 11 / 201, 90.0), (1 / 300, 1.0, None)} and out.count() == 10
