from __future__ import annotations

import random

import numpy as np
import pandas as pd

import corpus_pipeline
from postloom.llm import near_dedup, packing
from postloom.llm.common import Tables
from tests.llm.test_text_operators import CLEAN, docs


def brute_components(texts):
    import re

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()

    s = {i: shingles(t) for i, t in enumerate(texts)}
    c = {i: i for i in s}
    for i in s:
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]) and c[i] != c[j]:
                a, b = sorted((c[i], c[j]))
                c = {k: a if v == b else v for k, v in c.items()}
    return {i: (len(s[i]), c[i], c[i] == i) for i in s}


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
    return " ".join(w)


def test_groups_against_brute_force(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(120)] for _ in range(12)]
    texts = [edited(base[k % 12], rng.randint(0, 6), rng) for k in range(150)] + ["", None, "  ", "one two", "one two", "ONE\ttwo", "one two three"]
    texts += [edited(base[0], rng.randint(0, 3), rng) for _ in range(90)]  # a group larger than a leaf
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(docs(spark, texts), words=4).collect()}
    assert got == brute_components(texts)


def test_groups_links_pairs_within_a_dense_group(spark):
    """150 pairs at 0.81, all in one group whose other pairs are at 0.74: no leader is near, and nodes stay large."""
    shared = " ".join(f"s{k}" for k in range(170))
    texts = [" ".join([shared, *(f"p{i // 2}_{k}" for k in range(9)), *(f"o{i}_{k}" for k in range(21))]) for i in range(300)]
    got = {r.doc_id: r.component_id for r in near_dedup.groups(docs(spark, texts), words=1).collect()}
    assert got == {i: i // 2 * 2 for i in range(300)}


def test_groups_of_a_dense_group_at_the_threshold(spark):
    """700 edits of one text, whose pairs lie on both sides of the threshold."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(700):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(150)] = f"new{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(docs(spark, texts), words=4).collect()}
    want = brute_components(texts)
    assert 50 < sum(not kept for *_, kept in want.values()) < 650
    assert got == want


def test_groups_defined_cases(spark):
    same = "a b c d e"
    rows = [(None, same, 1), (3, same, 1), (3, same, 1), (2, "A B c d e", 1), (4, None, 1), (None, "  ", 1), (5, "another text by itself here", 1), (5, same, 1), (None, "x y z v w", 1), (None, "x y z v w", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first int")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.groups(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (-1, -1, True), (-1, 2, False), (2, 2, True), (3, 2, False), (3, 2, False), (4, 4, True), (5, 2, False), (5, 5, True)]
    assert near_dedup.groups(df.limit(0)).count() == 0
    left = sorted((r.doc_id or -1, r.text or "") for r in near_dedup.deduplicate(df).collect())
    assert left == [(-1, "  "), (-1, "x y z v w"), (2, "A B c d e"), (4, ""), (5, "another text by itself here")]
    assert near_dedup.deduplicate(df).columns == df.columns and near_dedup.deduplicate(df.limit(0)).count() == 0


def test_one_row_of_repeated_rows_stays(spark):
    rows = [(1, "one two three four five six", "x"), (1, "one two three four five six", "x"), (2, "seven eight nine ten eleven", "y")]
    left = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, __n string")).collect()
    assert sorted(tuple(r) for r in left) == [rows[0], rows[2]]


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, near_dedup.components(Tables(spark), edges, "x").collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(300)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    clean = [sentence(80) + "\n" + sentence(60) for _ in range(20)]
    leak = sentence(14)
    texts = [*clean, clean[0], clean[1].replace("word1 ", "word2 "), sentence(50) + "\n" + leak + "\n" + sentence(50), "!!! ### $$$ " * 30, CLEAN + " Mail me at ann@x.org today.", None, ""]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = docs(spark, texts)
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path)).checkpoint()
        after[name] = frame
        if name != "packing":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda n: {r.doc_id for r in after[n].select("doc_id").collect()}
    assert ids("quality_rules") == {*range(23), 24}
    assert ids("near_dedup") == {*range(20), 22, 24}
    assert ids("decontamination") == {*range(20), 24}
    assert after["pii"].where("doc_id = 24").first().text.endswith("Mail me at <EMAIL> today.")
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed["doc_id"]) == {*range(20), 24} and packed["sequence_id"].nunique() == -(-packed["length"].sum() // packing.CAPACITY)


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null ids, ids that rows share, repeated rows, columns with clashing names; and an empty table."""
    rng = random.Random(5)
    sentence = lambda n: " ".join(f"word{rng.randint(0, 300)}" for _ in range(n)) + "."
    a, b, c, d, leak = (sentence(60) for _ in range(5))
    rows = [(1, a, "x"), (1, a, "x"), (2, a, "y"), (None, b, "z"), (None, b, "z"), (3, f"{c}\n{leak}", "p"), (3, d, "q"), (None, f"{d} {d[:20]}.\n{leak}", "r")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = frame.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame, empty = stage(spark, frame, str(tmp_path)).checkpoint(), stage(spark, empty, str(tmp_path)).checkpoint()
        assert frame.columns == ["doc_id", "text", "kept"] and empty.count() == 0
        if name == "near_dedup":
            assert sorted(r.kept for r in frame.collect()) == ["p", "q", "r", "x", "z"]
    assert sorted(r.kept for r in frame.collect()) == ["q", "x", "z"]
    assert packing.pack(empty).count() == 0


def test_nodes_are_branched_by_what_they_carry():
    rng = np.random.default_rng(3)
    sketches = pd.DataFrame({"cls": [*range(9)], "sketch": [rng.integers(0, 4, near_dedup.COORDINATES).astype("<u4").tobytes() for _ in range(9)]})
    (roots,) = near_dedup._roots(iter([sketches]))
    assert set(roots) == {"node", "cls", "own"} and len(roots) == 9 * near_dedup.TREES
    for level in range(1, near_dedup.LEVELS):
        (below,) = near_dedup._children(level)(iter([roots[["node", "cls", "own"]]]))
        tokens = np.frombuffer(b"".join(sketches["sketch"]), "<u4").reshape(9, -1)[below["cls"], (roots["node"] & 255) + level * near_dedup.TREES]
        assert below.groupby("node").ngroups == pd.DataFrame({"node": roots["node"], "token": tokens}).drop_duplicates().shape[0]
        roots = below
