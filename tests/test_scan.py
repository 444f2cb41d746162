from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postloom.operators import metrics, ordering, scan
from postloom.streaming import streams

T0 = datetime(2024, 1, 1)


def hot(rng, n=3000):
    """Keys of rows: one has a third, some have a few, one is null."""
    return ["hot" if k % 3 == 0 else None if k % 31 == 0 else f"k{rng.randint(0, 60)}" for k in range(n)]


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_a_hot_key_is_divided(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([(k, i) for i, k in enumerate(hot(rng))], "key string, at long")
    sizes = scan.blocks(df, "key", ["at"]).groupBy("key", F.spark_partition_id().alias("b")).count().where("key = 'hot'").collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 600


def test_running_figures(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, 0, 0, 1, 5]), rng.random() < 0.1) for i, k in enumerate(hot(rng))]
    df = spark.createDataFrame(rows, "key string, at long, n long, flag boolean").repartition(5)
    got = {(r["key"], r["at"]): r for r in scan.running(df, "key", ["at"], {"total": F.col("n")}, {"most": F.col("n")}, {"since": F.col("flag")}, {"last": F.struct("n")}).collect()}
    assert len(got) == len(rows)
    for key, mine in by_key(rows).items():
        total, most, since, last = 0, None, 0, None
        for r in mine:
            total += r[2] or 0
            most = r[2] if most is None else most if r[2] is None else max(most, r[2])
            since = 0 if r[3] else since + 1
            x = got[key, r[1]]
            assert (x["total"], x["most"], x["since"], x["last"] and x["last"]["n"], x["last"] is None) == (total, most, since, last and last[0], last is None)
            last = (r[2],)


def chosen(times, values, wait, forget):
    opened = shown = before = None
    out = []
    for t, v in zip(times, values):
        let = opened is None or forget is not None and t - before >= forget or t - opened >= wait and (v is False or v != shown)
        if let:
            opened, shown = t, v
        before = t
        out.append((let, opened))
    return out


@pytest.mark.parametrize("span, wait, forget", [(4000, 60, None), (4000, 60, 45), (400_000, 60, None), (10_000_000, 1, 50_000), (900, 5000, None), (5000, 0, 400)])
def test_rows_chosen_by_time(spark, span, wait, forget):
    """Dense and thin rows, long and short waits, and blocks within which nothing is chosen."""
    rng = random.Random(span + wait)
    rows = sorted((k, rng.randrange(span), i) for i, k in enumerate(hot(rng, 2000)) if k) + [(None, t, -t - 1) for t in range(0, span, span // 100)]
    rows = [(k, T0 + timedelta(seconds=t), c, i) for (k, t, i), c in zip(rows, [rng.choice("ab") for _ in rows])]
    once = {(r[0], r[1]): r for r in rows}  # equal times have no order
    rows = list(once.values())
    df = spark.createDataFrame(rows, "key string, ts timestamp, counters string, id long").repartition(4)
    visits = {r.id: (r.first, r.served_from) for r in streams.served(df, wait).collect()}
    let = {r.id for r in streams.throttled(df.withColumnRenamed("key", "job_id"), wait, forget).collect()}
    for mine in by_key(rows).values():
        mine.sort(key=lambda r: r[1])
        times = [(r[1] - T0).total_seconds() for r in mine]
        for r, (first, opened) in zip(mine, chosen(times, [False] * len(mine), wait, None)):
            assert visits[r[3]] == (first, T0 + timedelta(seconds=opened))
        for r, (first, _) in zip(mine, chosen(times, [r[2] for r in mine], wait, forget)):
            assert (r[3] in let) == first
    assert len(visits) == len(rows)


def test_rules_of_rounds_on_a_hot_source(spark):
    rng = random.Random(7)
    rows = [(k, i, rng.choice([0, 0, 0, 1, 2]), True, rng.random() < 0.001, False) for i, k in enumerate(hot(rng, 1500))]
    schema = "source string, round long, items long, has_more boolean, cancelled boolean, failed boolean"
    df = spark.createDataFrame(rows, schema).repartition(3)
    stale = {r.source: r.round for r in ordering.stale_at(df.withColumnRenamed("items", "new_items"), 5).collect()}
    stops = {r.source: (r.stop_reason, r.items_kept) for r in ordering.pagination_stop(df, 700, 10**6, 9).collect()}
    cut = {}
    for r in streams.capped(df, 90, 7).collect():
        cut.setdefault(r.source, []).append((r.round, r.taken, r.stop_reason))
    for key, mine in by_key(rows).items():
        streak, first = 0, None
        for r in mine:
            streak = 0 if r[2] else streak + 1
            first = r[1] if first is None and streak >= 5 else first
        assert stale.get(key) == first
        streak = total = 0
        stop = None
        for r in mine:
            n = 0 if r[4] else r[2]
            total, streak = total + n, 0 if n else streak + 1
            stop = "cancelled" if r[4] else "stale" if streak >= 9 else "item_cap" if total >= 700 else None
            if stop:
                break
        assert stops.get(key) == ((stop, min(total, 700)) if stop else None)
        streak = total = 0
        want = []
        for r in mine:
            take = min(r[2], 90 - total)
            total, streak = total + take, 0 if r[2] else streak + 1
            want.append((r[1], take, "stale" if streak >= 7 else "item_cap" if total >= 90 else None))
            if want[-1][2]:
                break
        assert sorted(cut[key]) == want


def test_changed_progress_and_most_so_far(spark):
    rng = random.Random(9)
    rows = [(k, i, rng.choice(["a", "a", "b", None])) for i, k in enumerate(hot(rng, 900))]
    got = {r.seq for r in ordering.changed_progress(spark.createDataFrame(rows, "job_id string, seq long, counters string")).collect()}
    want = {r[1] for mine in by_key(rows).values() for a, r in zip([None, *mine], mine) if a is None or a[2] != r[2]}
    assert got == want
    seen = spark.createDataFrame([("c", i, f"p{j}") for i in range(30) for j in range((i * 7) % 11)], "capture string, round long, post_id string")
    for r in metrics.seen_in_rounds(seen).collect():
        assert r.most_so_far == max((i * 7) % 11 for i in range(r["round"] + 1))


def test_empty_tables_and_clashing_names(spark):
    assert scan.running(spark.createDataFrame([], "key string, at long"), "key", ["at"], {"n": F.lit(1)}).count() == 0
    assert streams.served(spark.createDataFrame([], "key string, ts timestamp"), 5).count() == 0
    df = spark.createDataFrame([("a", 1, 5, 6), ("a", 2, 7, 8)], "key string, at long, __block long, __own_n long")
    assert sorted(map(tuple, scan.running(df, "key", ["at"], {"n": F.col("at")}).collect())) == [("a", 1, 5, 6, 1), ("a", 2, 7, 8, 3)]
