from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postloom import schemas
from postloom.operators import dedup, filters, joins, metrics, ordering, updates
from postloom.operators.normalize import normalize_posts
from postloom.plans import slices


def posts(spark, rows):
    """Canonical posts from dicts of some fields."""
    schema = schemas.CANONICAL_POST.jsonValue()
    names = [f.name for f in schemas.CANONICAL_POST]
    extra = sorted({k for r in rows for k in r} - set(names))
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.CANONICAL_POST)
    assert schema
    if extra:
        from pyspark.sql import types as T

        kinds = {k: T.LongType() if isinstance(next(r[k] for r in rows if k in r), int) else T.StringType() for k in extra}
        full = T.StructType([*schemas.CANONICAL_POST.fields, *[T.StructField(k, kinds[k]) for k in extra]])
        df = spark.createDataFrame([tuple(r.get(n) for n in [*names, *extra]) for r in rows], full)
    return df


def test_normalized_post(spark):
    row = {f.name: None for f in schemas.PARSED_POST} | {"post_id": "1", "text": " Hi #tag @ann. ", "mentions": ["Bob", "Bob"], "external_links": ["https://x.org", ""], "reaction_like_count": 2, "reaction_sad_count": 1, "published_at": datetime(2024, 1, 2)}
    df = spark.createDataFrame([tuple(row[f.name] for f in schemas.PARSED_POST)], schemas.PARSED_POST)
    got = normalize_posts(df, F.lit("P"), F.lit("9"), F.lit("https://s"), F.lit(datetime(2024, 6, 1))).first()
    assert got.asDict() | {"scraped_at": None} == {f.name: None for f in schemas.CANONICAL_POST} | {
        "post_id": "1", "source_url": "https://s", "page_name": "P", "page_id": "9", "profile_url": "https://s", "post_type": "link", "published_at": datetime(2024, 1, 2), "timestamp": 1704153600, "text": "Hi #tag @ann.",
        "hashtags": ["#tag"], "mentions": ["Bob", "@ann"], "external_links": ["https://x.org"], "reactions": 3, "reaction_like_count": 2, "reaction_sad_count": 1,
    }
    assert [f.name for f in schemas.CANONICAL_POST] == list(got.asDict()) and len(got) == 33


def test_filters(spark):
    df = posts(spark, [{"post_id": "1", "post_type": "text", "published_at": datetime(2024, 1, 31, 23)}, {"post_id": "2", "post_type": None, "published_at": None}, {"post_id": "3", "post_type": "image", "published_at": datetime(2024, 2, 1)}])
    ids = lambda d: sorted(r.post_id for r in d.collect())
    assert ids(filters.date_type_filter(df)) == ["1", "2", "3"]
    assert ids(filters.date_type_filter(df, "2024-01-31", "2024-01-31")) == ["1"]
    assert ids(filters.date_type_filter(df, None, None, "image")) == ["3"]
    assert ids(filters.date_type_filter(df, None, None, "all")) == ["1", "2", "3"]
    for bad in ({"urls": []}, {"urls": ["x"], "max_posts": True}, {"urls": ["x"], "max_posts": -1}, {"urls": ["x"], "start": "2024-02-01", "end": "2024-01-01"}, {"urls": ["x"], "post_type": "poem"}):
        with pytest.raises(ValueError):
            filters.check_options(**bad)
    with pytest.raises(ValueError):
        filters.statuses("running,odd")


def test_search_blank_is_all(spark):
    df = posts(spark, [{"post_id": "1", "text": "Hello", "hashtags": ["#Red"], "mentions": []}, {"post_id": "2", "text": None, "hashtags": [], "mentions": []}])
    assert filters.search(df, "  ", filters.POST_SEARCH).count() == 2
    assert [r.post_id for r in filters.search(df, "hello #RED", filters.POST_SEARCH).collect()] == ["1"]


def test_dedup_keeps_first(spark):
    df = posts(spark, [{"post_id": "a", "ord": 2, "text": "later"}, {"post_id": "a", "ord": 1, "text": "first"}, {"post_id": "", "ord": 3, "text": "x"}, {"post_id": None, "ord": 4, "text": "x"}])
    got = {r.ord for r in dedup.dedup_posts(df).collect()}
    assert got == {1, 3} and {r.ord for r in dedup.dedup_posts(df.repartition(5)).collect()} == got


def greedy(rows, keys):
    """The sequential rule. keys: key and content of each post by ord."""
    inside, seen = [], set()
    for r in sorted(rows, key=lambda r: (r["source"], r["ord"])):
        if (r["source"], keys[r["ord"]][0]) not in seen:
            seen.add((r["source"], keys[r["ord"]][0]))
            inside.append(r)
    kept, ks, cs = set(), set(), set()
    for r in inside:
        k, c = keys[r["ord"]]
        if k not in ks and c not in cs:
            kept.add(r["ord"]), ks.add(k), cs.add(c)
    return kept


@pytest.mark.parametrize("whole", [dedup.WHOLE, 25, 3, 0])
def test_across_sources_is_greedy(spark, whole):
    """In one task, in parts, and by rounds: random keys and contents, and chains."""
    rng = random.Random(3)
    rows = [{"post_id": rng.choice(["k1", "k2", "k3", "k4", "k5", None]), "text": rng.choice("abcdef"), "source": rng.choice(["s1", "s2", "s3"]), "ord": i} for i in range(60)]
    rows += [{"post_id": f"c{j}_{(i + 1) // 2}", "text": f"t{j}_{i // 2}", "source": f"s{i % 7}", "ord": 100 + 30 * j + i} for j in range(4) for i in range(14)]
    df = posts(spark, rows)
    keys = {r.ord: (r.k, r.c) for r in df.select("ord", dedup.dedup_key().alias("k"), dedup.content_fingerprint().alias("c")).collect()}
    assert {r.ord for r in dedup.dedup_across_sources(df, whole=whole).collect()} == greedy(rows, keys)
    assert dedup.dedup_across_sources(df.limit(0), whole=whole).count() == 0


def test_a_long_chain_takes_few_jobs(spark):
    """Each post shares its key with the next and its content with the one before."""
    rows = [{"post_id": f"k{(i + 1) // 2}", "text": f"t{i // 2}", "source": f"s{i:05}", "ord": i} for i in range(10_000)]
    df = posts(spark, rows)
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        kept = {r.ord for r in dedup.dedup_across_sources(df).collect()}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == set(range(0, 10_000, 2))
    assert len(jobs) < 10


def test_slice_is_balanced_in_both_orders(spark):
    df = posts(spark, [{"post_id": str(i % 4), "ord": i, "source": "s", "post_type": "text" if i % 3 else "image", "text": "t"} for i in range(12)])
    for order in slices.ORDERS:
        b = metrics.bookkeeping(slices.judged(df, "source", post_type="text", most=2, order=order)).first()
        assert b.balanced and b.discovered == 12 and b.extracted == 2 and b.skipped == 10


def test_dom_copies(spark):
    rows = [(1, 1, "9", "Big News today"), (1, 2, None, "Verified account big news"), (1, 3, None, "other"), (2, 1, None, "big news"), (1, 4, None, None), (1, 5, "7", "other things")]
    df = spark.createDataFrame(rows, "page_key long, ord int, post_id string, text string")
    assert sorted((r.page_key, r.ord) for r in joins.drop_dom_copies(df).collect()) == [(1, 1), (1, 3), (1, 4), (1, 5), (2, 1)]


def test_job_kpi_rules(spark):
    p = spark.createDataFrame([(1, 1, "video", None, datetime(2024, 1, 1)), (2, 1, None, "u", None), (3, 1, "image", "u", datetime(2024, 1, 3))], "id long, job_id long, post_type string, video_url string, published_at timestamp")
    e = spark.createDataFrame([(1, 5, None, None, None, 0)], "id long, likes long, reactions long, comments_count long, shares long, views_count long")
    r = metrics.job_kpi(p, e).first()
    assert (r.total_posts, r.total_likes, r.total_views, r.n_video, r.n_image, r.earliest, r.latest) == (3, 5, None, 2, 1, "2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z")


def test_pagination_stops(spark):
    rounds = [("stale", r, 3 if r == 1 else 0, True, False, False) for r in range(1, 8)] + [("cap", r, 6, True, False, False) for r in range(1, 5)] + [("end", 1, 2, False, False, False)]
    rounds += [("cancel", 1, 2, True, False, False), ("cancel", 2, 0, True, True, False), ("most", 1, 1, True, False, False)] + [("most", r, 1, True, False, False) for r in range(2, 9)] + [("fail", 1, 1, True, False, True)]
    df = spark.createDataFrame(rounds, "source string, round int, items int, has_more boolean, cancelled boolean, failed boolean")
    got = {r.source: (r.stop_reason, r.total_rounds, r.items_kept) for r in ordering.pagination_stop(df, 10, 6).collect()}
    assert got == {"stale": ("stale", 4, 3), "cap": ("item_cap", 2, 10), "end": ("no_more", 1, 2), "cancel": ("cancelled", 1, 2), "most": ("max_rounds", 6, 6), "fail": ("fetch_error", 1, 0)}


def test_updates(spark):
    jobs = spark.createDataFrame([(1, "running"), (2, "queued"), (3, "paused")], "id long, status string")
    sources = spark.createDataFrame([(1, 7, "running"), (1, 8, "completed"), (3, 9, "running")], "job_id long, source_id long, status string")
    j, s, e, q = updates.sweep_orphans(jobs, sources)
    assert sorted(map(tuple, j.collect())) == [(1, "failed"), (2, "queued"), (3, "paused")]
    assert sorted((r.source_id, r.status) for r in s.collect()) == [(7, "failed"), (8, "completed"), (9, "running")]
    assert [r.code for r in e.collect()] == ["suspended_by_restart"] and [r.id for r in q.collect()] == [2]
    old = spark.createDataFrame([(1, "a", 5)], "k int, x string, y int")
    new = spark.createDataFrame([(1, None, 6), (2, "b", None)], "k int, x string, y int")
    assert sorted(map(tuple, updates.merge(old, new, ["k"]).collect())) == [(1, "a", 6), (2, "b", None)]


def test_resume_states(spark):
    df = spark.createDataFrame([(1, 1, 1, "failed"), (2, 1, 1, "completed"), (3, 2, 1, "running"), (1, 2, 1, "failed")], "id long, source_id long, job_id long, status string")
    assert [(r.id, r.status) for r in ordering.resume_states(df).collect()] == [(2, "completed")]


def test_pages_of_few_texts_need_no_grams(spark, monkeypatch):
    asked = []
    whole = joins.containments
    monkeypatch.setattr(joins, "containments", lambda texts, q: asked.append(texts.select("page_key").distinct().count()) or whole(texts, q))
    rows = [(1, 0, "7", "Good morning all of you"), (1, 1, None, "morning ALL"), (1, 2, None, "other words"), (1, 3, "8", "other"), (2, 0, None, "ab"), (2, 1, "9", "abc")]
    rows += [(3, k, str(k) if k < 20 else None, f"text number {k % 20} of the page") for k in range(40)]
    got = joins.drop_dom_copies(spark.createDataFrame(rows, "page_key long, ord int, post_id string, text string")).select("page_key", "ord").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 2), (1, 3), (2, 0), (2, 1), *[(3, k) for k in range(20)]] and asked == [1]


@pytest.mark.parametrize("few", [0, 2, 10_000])
def test_what_is_deleted_is_hashed_and_the_tables_are_not_sorted(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW_JOBS", few)
    rng = random.Random(5)
    jobs = [(k,) for k in range(40)]
    posted = [(k, rng.choice([None, *range(45)])) for k in range(300)]
    metrics_of = [(rng.choice([None, *range(320)]), k) for k in range(400)]
    gone = [(k,) for k in (*range(0, 50, 5), 5, None)]
    tables = {"jobs": spark.createDataFrame(jobs, "id long"), "posts": spark.createDataFrame(posted, "id long, job_id long"), "engagement": spark.createDataFrame(metrics_of, "id long, n long")}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        left = joins.without_job(tables, spark.createDataFrame(gone, "job_id long"))
        got = {name: sorted(map(tuple, df.collect()), key=repr) for name, df in left.items()}
        plans = {name: df._jdf.queryExecution().toString() for name, df in left.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    ids = {k for k, in gone} - {None}
    posts_gone = {k for k, job in posted if job in ids}
    assert got["jobs"] == sorted([x for x in jobs if x[0] not in ids], key=repr)
    assert sorted(tuple(r) for r in left["posts"].select("id", "job_id").collect() if r.job_id is not None) == sorted(x for x in posted if x[1] is not None and x[1] not in ids)
    assert sum(x[1] is None for x in posted) == left["posts"].where("job_id IS NULL").count()
    assert sorted(map(tuple, left["engagement"].select("id", "n").collect()), key=repr) == sorted([x for x in metrics_of if x[0] not in posts_gone], key=repr)
    for plan in plans.values():
        assert "SortMergeJoin" not in plan and "Sort [" not in plan
    assert "ShuffledHashJoin" in plans["engagement"] and ("BroadcastHashJoin" in plans["jobs"]) == (few > len(gone))
