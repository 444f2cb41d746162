from __future__ import annotations

import random
import re

import numpy as np
import pytest

from postloom.llm import ngram_join
from postloom.llm.near_dedup import shingles
from tests.llm.test_groups_and_pipeline import edited
from tests.llm.test_text_operators import docs


def brute(texts, words=4, threshold=85):
    def of(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    s = [of(t) for t in texts]
    c = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and c[i] != c[j] and 100 * len(s[i] & s[j]) >= threshold * len(s[i] | s[j]):
                a, b = sorted((c[i], c[j]))
                c = [a if v == b else v for v in c]
    return {i: (len(s[i]), c[i]) for i in range(len(s))}


def got(spark, texts, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, texts).repartition(4), **({"words": 4, "threshold": 85} | more)).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(n)] for n in (30, 60, 90, 150, 190, 210, 230, 300)]
    passage = [f"p{k}" for k in range(55)]
    texts = [edited(base[k % 8], rng.randint(0, 1 + len(base[k % 8]) // 40), rng) for k in range(200)] + ["", None, "  ", "one two", "one two", "ONE\ttwo", "one two three", "a b c d", "a b c d e", "b c d e"]
    texts += [" ".join([*(f"u{k}_{j}" for j in range(rng.randint(0, 12))), *passage]) for k in range(80)]  # a passage that many share
    texts += [" ".join(base[4] + [f"x{rng.randint(0, 3)}" for _ in range(rng.randint(0, 40))]) for _ in range(40)]  # sizes on both sides of SHORT
    rng.shuffle(texts)
    assert got(spark, texts) == brute(texts)


def test_a_dense_group_at_the_threshold(spark):
    """500 edits of one text, whose pairs lie on both sides of the threshold."""
    rng = random.Random(4)
    base, texts = [f"w{k}" for k in range(150)], []
    for _ in range(500):
        w = list(base)
        for _ in range(rng.randint(1, 7)):
            w[rng.randrange(150)] = f"new{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    want = brute(texts)
    assert 50 < sum(c != i for i, (_, c) in want.items()) < 450
    assert got(spark, texts) == want


def test_pairs_within_a_dense_group(spark):
    """150 pairs at 0.86, all in one group whose other pairs are at 0.8: nodes stay large, and no central class is near."""
    shared = " ".join(f"s{k}" for k in range(178))
    texts = [" ".join([shared, *(f"p{i // 2}_{k}" for k in range(7)), *(f"o{i}_{k}" for k in range(15))]) for i in range(300)]
    assert got(spark, texts, words=1) == {i: (200, i // 2 * 2) for i in range(300)} == brute(texts, 1)


@pytest.mark.parametrize("threshold", [50, 80, 85, 95, 100])
def test_pairs_at_the_threshold_share_a_key(threshold):
    """Whatever tokens are frequent, and on both sides of the size up to which pairs of tokens are indexed."""
    rng = np.random.default_rng(threshold)
    for trial in range(400):
        n = int(rng.integers(2, 70))
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        n = len(s)
        drop = int(rng.integers(0, n - ngram_join.overlap(n, threshold) + 1))
        other = np.unique(np.concatenate([rng.permutation(s)[drop:], rng.integers(0, 2**63, int(rng.integers(0, n))).astype(np.uint64)]))
        while 100 * len(np.intersect1d(s, other)) < threshold * len(np.union1d(s, other)):
            other = np.setdiff1d(other, np.setdiff1d(other, s)[:1]) if len(np.setdiff1d(other, s)) else np.union1d(other, np.setdiff1d(s, other)[:1])
        if np.array_equal(s, other):
            continue
        both = np.union1d(s, other)
        tokens = np.sort(rng.permutation(both)[: int(rng.integers(0, len(both) + 1))])
        frequent = tokens, rng.integers(1, 5, len(tokens))
        a, b = (ngram_join.keys_of(x, frequent, threshold, short=30) for x in (s, other))
        assert len(np.intersect1d(a, b)), (n, len(other), trial)


def test_bitmaps_rule_out_no_link():
    import pandas as pd

    rng = random.Random(2)
    base = [f"w{k}" for k in range(3000)]
    for n in (5, 40, 400, 3000):
        sets = [shingles(edited(base[:n], k, rng), 1) for k in (0, n // 20, n // 10)]
        rows = pd.DataFrame({"cls": range(3), "c": range(3), "n": [len(s) for s in sets], "bits": [ngram_join.bitmap(s) for s in sets], "step": 0})
        found = ngram_join._possible(85)(rows, np.array([0, 3]))
        if any(100 * len(np.intersect1d(sets[0], s)) >= 85 * len(np.union1d(sets[0], s)) for s in sets[1:]):
            assert len(found)


def test_defined_cases(spark):
    same = "a b c d e f"
    rows = [(None, same, 1), (3, same, 1), (3, same, 1), (2, "A B c d e f", 1), (4, None, 1), (None, "  ", 1), (5, "another text by itself here", 1), (5, same, 1), (None, "x y z v w", 1), (None, "x y z v w", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls int")
    out = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.join(df).collect())
    assert out == [(-1, -1), (-1, -1), (-1, -1), (-1, 2), (2, 2), (3, 2), (3, 2), (4, 4), (5, 2), (5, 5)]
    assert ngram_join.join(df.limit(0)).count() == 0
    long = " ".join(f"w{k}" for k in range(60_000))
    assert got(spark, [long, long + " end", "w1 w2"]) == {0: (59_997, 0), 1: (59_998, 0), 2: (1, 2)}


def test_the_number_of_frequent_tokens_changes_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST", 2)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(100)]
    texts = [edited(base, rng.randint(0, 4), rng) for _ in range(120)]
    want = brute(texts)
    assert got(spark, texts, most=10**6) == got(spark, texts, most=0) == got(spark, texts, most=30, short=0) == want
