from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postloom.operators import filters, joins, metrics, paging, search


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["Apple", "banana", "añb", "Ωmega", "aaaa", "x y"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 6))), rng.choice([None, "", "Page"])) for k in range(400)] + [(400, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, name string").repartition(4)
    table = search.TrigramTable(df, "id", ["name", "text"], str(tmp_path / "t"), buckets=32).write()
    ids = lambda d: sorted(r.id for r in d.select("id").collect())
    for query in ("  PPL ", "a3 Apple", "ñb", "ωmega7", "aaaaaaa", "aaaa1", "nothing", "e ", "x y3 x y", "", "page a"):
        assert ids(table.search(query)) == ids(filters.search(df, query, ["name", "text"])), query
    assert table.postings("Ωmega").count() < table.rows.sparkSession.read.parquet(str(tmp_path / "t")).count() / 5
    files = lambda d: d.select(F.input_file_name()).distinct().count()
    assert files(table.postings("ppl")) == 1
    table.drop()


def test_pages_and_places(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *range(30)]), k) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, at int, place long").repartition(5)
    order = [F.desc_nulls_last("at"), F.desc("id")]
    o = paging.Ordered(df, order, str(tmp_path / "o"), ranges=10)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), -r[0]))]
    assert len(o) == 1000 and len(o.ranges) > 5
    for page, size in ((1, 50), (2, 50), (20, 50), (21, 50), (7, 33), (1, 999), (0, 3), (143, 7)):
        got = o.page(page, size, 200)
        n = min(size, 200)
        start = (max(1, page) - 1) * n
        assert [r.id for r in got.collect()] == want[start : start + n]
    assert len(o.held_by(500, 20)) <= 2
    assert o.page(11, 20, 50).columns == df.columns
    assert {r.id: r.nth for r in o.places("nth").collect()} == {i: k for k, i in enumerate(want, 1)}
    none = paging.Ordered(df.limit(0), order, str(tmp_path / "none"))
    assert len(none) == 0 and none.page(1, 5, 5).count() == 0 and none.places().count() == 0


def histogram_quantile(share, values, ends):
    n = len(values)
    if not n:
        return None
    upto = [sum(v <= e for v in values) for e in ends]
    for k, e in enumerate(ends):
        before, low = (upto[k - 1], ends[k - 1]) if k else (0, 0.0)
        if upto[k] >= share * n and upto[k] > before:
            return low + (e - low) * (share * n - before) / (upto[k] - before)
    return ends[-1]


def test_quantiles_of_histograms(spark):
    rng = random.Random(3)
    groups = {"even": [rng.random() for _ in range(300)], "one": [0.3], "over": [100.0] * 5, "low": [0.001, 0.002], "none": [], "mixed": [0.01] * 90 + [7.0] * 10, "at ends": [0.005, 0.01, 0.025, 60.0]}
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for share in (0.5, 0.95):
        got = {r.g: r.q for r in df.groupBy("g").agg(metrics.bucket_counts(F.col("v")).alias("c")).select("g", metrics.histogram_quantile(share, F.col("c")).alias("q")).collect()}
        for g, vs in groups.items():
            assert got[g] == pytest.approx(histogram_quantile(share, vs, metrics.BUCKETS)), g
    parts = df.groupBy("g", (F.rand(1) < 0.5).alias("half")).agg(metrics.bucket_counts(F.col("v")).alias("c"))
    added = parts.groupBy("g").agg(F.array(*[F.sum(F.col("c")[k]) for k in range(len(metrics.BUCKETS) + 1)]).alias("c"))
    whole = df.groupBy("g").agg(metrics.bucket_counts(F.col("v")).alias("c"))
    assert sorted(map(tuple, added.collect())) == sorted(map(tuple, whole.collect()))


def test_copies_within_pages_against_all_pairs(spark):
    rng = random.Random(4)
    words = ["big", "news", "today", "a", "b", "Verified account", "of", "the town"]
    rows = [(k % 7, k, rng.choice([None, "", "1", "2"]), rng.choice([None, "", " ", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(9))])) for k in range(420)]
    df = spark.createDataFrame(rows, "page_key long, ord int, post_id string, text string").repartition(3)

    def clean(t):
        return " ".join(t.replace("Verified account", "").split()).lower()

    want = set()
    for page, ord_, post, text in rows:
        held = not post and text and any(p == page and o < ord_ and i and t and (clean(text) in clean(t) or clean(t) in clean(text)) for p, o, i, t in rows)
        if not held:
            want.add((page, ord_))
    got = joins.drop_dom_copies(df)
    assert {(r.page_key, r.ord) for r in got.collect()} == want and got.columns == df.columns


def test_a_page_of_many_texts_has_no_quadratic_pairs(spark):
    rows = [(1, k, str(k) if k % 2 else None, f"Big news today about town {k // 2:05} and more of it") for k in range(4000)] + [(1, 5000, None, "town 00007 and"), (1, 5001, None, "about"), (1, 5002, None, "nowhere")]
    df = spark.createDataFrame(rows, "page_key long, ord int, post_id string, text string")
    texts = df.select("page_key", F.lower("text").alias("text")).distinct()
    assert joins.containments(texts).count() == 2001
    left = {r.ord for r in joins.drop_dom_copies(df).collect()}
    assert left == set(range(4000)) | {5002}


def test_texts_that_lie_together_share_a_list_of_each_trigram(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab\0 é漢😀") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", "ab", "aaa", "x" * 500]
    want = {(t[i : i + 3], k) for k, t in enumerate(texts) for i in range(len(t) - 2)}
    for chars, size in ((1, 1), (40, 7), (100, 300), (1 << 20, 300)):
        rows = [(k, t.encode()) for k, t in enumerate(texts)]
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in x], pa.int64()), pa.array([t for _, t in x])], ["id", "text"]) for x in (rows[a : a + size] for a in range(0, len(rows), size))]
        got = [(r["gram"], k) for b in search._listed(chars)(iter(batches)) for r in b.to_pylist() for k in r["keys"]]
        assert len(got) == len(set(got)) and set(got) == want
    every = "".join(chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000)  # too many kinds of letters for many texts
    many = [every[a : a + 1000] for a in range(0, len(every), 1000)] * 10
    lists = [r for b in search._lists(pa.array(range(len(many))), many) for r in b.to_pylist()]
    assert {(r["gram"], k) for r in lists for k in r["keys"]} == {(t[i : i + 3], k) for k, t in enumerate(many) for i in range(len(t) - 2)}
    df = spark.createDataFrame(list(enumerate(t.replace("\0", "c") for t in texts)), "id long, text string").coalesce(1)
    table = search.TrigramTable(df, "id", ["text"], str(tmp_path / "t"), buckets=4).write()
    assert spark.read.parquet(str(tmp_path / "t")).count() == len({g.replace("\0", "c") for g, _ in want})
    table.drop()


def test_texts_are_not_sorted_for_the_candidates(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(k, f"Town {k % 50:03} and more") for k in range(500)], "id long, text string").repartition(3)
    table = search.TrigramTable(df, "id", ["text"], str(tmp_path / "t"), buckets=4).write()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        for sent, join in ((10, "BroadcastHashJoin"), (9, "ShuffledHashJoin")):
            monkeypatch.setattr(search, "SENT", sent, raising=False)
            got = table.search("OWN 007")
            assert sorted(r.id for r in got.collect()) == list(range(7, 500, 50))
            plan = got._jdf.queryExecution().toString()
            assert join in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    table.drop()
