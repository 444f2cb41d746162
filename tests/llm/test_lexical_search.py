from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from postloom.llm import lexical_search
from tests.llm.test_text_operators import docs, loud

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(texts, items, top=20):
    """By item: (doc, score), straight from the definitions. texts and items: (id, text)."""
    of = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d = [(i, Counter(of(t))) for i, t in texts]
    n_docs, total = sum(bool(c) for _, c in d), sum(c.total() for _, c in d)
    df = Counter(t for _, c in d for t in c)
    out = []
    for item, t in items:
        found = []
        for i, c in d:
            m = 75 + 25 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 12 * m)) for x in of(t))
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
        out += [(item, rank, i, score) for rank, (score, i) in enumerate(found[:top], 1)]
    return sorted(out, key=repr)


def got(spark, texts, items, **more):
    left = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, rank int")
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in lexical_search.search(left.repartition(3), right, **more).collect()), key=repr)


def corpus(n, seed, size=(1, 60)):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    return [(k, " ".join(word() for _ in range(rng.randint(*size)))) for k in range(n)]


def test_against_brute_force(spark):
    texts = corpus(700, 1)
    items = [(100 + k, loud(t) + "; unseen!") for k, (_, t) in enumerate(corpus(30, 2, (1, 25)))]
    assert got(spark, texts, items) == brute(texts, items)
    assert got(spark, texts, items[:5], top=3) == brute(texts, items[:5], 3)


def test_defined_cases(spark):
    texts = [(1, "red fox"), (None, "red fox"), (3, None), (4, ""), (5, " .,- "), (2, "Red FOX red"), (2, "Red FOX red"), (6, "blue éte 9" * 3000), (7, "fox-red_9")]
    items = [(1, "red"), (1, "red"), (None, "fox fox red"), (2, None), (3, "nothing here"), (4, ""), (5, "ÉTE éte 9 9")]
    want = brute(texts, items)
    assert got(spark, texts, items) == want and {w[0] for w in want} == {1, None, 5}
    assert got(spark, [], items) == [] and got(spark, texts, []) == []
    same = [(k, "one two three") for k in range(90, 0, -1)] + [(k, f"other{k}") for k in range(100, 300)]
    assert got(spark, same, [(1, "two")]) == [(1, k, k, s) for _, k, _, s in brute(same, [(1, "two")])]


def test_blocks_of_items_and_small_trees(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "TERMS", 40)
    monkeypatch.setattr(lexical_search, "ITEMS", 4)
    texts, items = corpus(200, 5), corpus(15, 6, (1, 20))
    assert got(spark, texts, items) == brute(texts, items)


def points_of(texts, vocabulary):
    counts = [lexical_search.term_counts(t) for t in texts]
    counts = [Counter({t: n for t, n in c.items() if t in vocabulary}) for c in counts]
    begins = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
    flat = lambda f: np.array([f(t, n) for c in counts for t, n in c.items()], np.int64)
    return lexical_search.Points(np.arange(len(texts)), np.zeros(len(texts), bool), begins, flat(lambda t, n: vocabulary[t]), flat(lambda t, n: 1000 * n))


def test_bounds_hold_and_prune():
    rng = random.Random(8)
    topics = [[f"t{k}x{j}" for j in range(30)] for k in range(40)]
    texts = [" ".join(rng.choices(topics[rng.randrange(40)], k=25)) for _ in range(3000)]
    vocabulary = {t: k for k, t in enumerate(sorted({w.encode() for t in topics for w in t}))}
    points = points_of(texts, vocabulary)
    weight = np.full(len(vocabulary), 7.0)
    tree = lexical_search.BallTree(points, weight)
    assert sorted(tree.points.ids.tolist()) == list(range(3000))
    seen = 0
    for item in texts[:20]:
        counts = lexical_search.term_counts(item)
        terms, repeats = np.array([vocabulary[t] for t in counts]), np.array(list(counts.values()))
        q = np.zeros(len(vocabulary), np.int64)
        q[terms] = 7 * repeats
        scores = np.add.reduceat(tree.points.entries * q[tree.points.terms], tree.points.begins[:-1])
        bounds = tree.bounds(terms, repeats)
        for node, leaf in enumerate(tree.leaves):
            if leaf:
                assert scores[slice(*leaf)].max() <= bounds[node]
        best = lexical_search.Best(20)
        seen += lexical_search.visit(tree, terms, repeats, q, best)
        assert best.score.tolist() == sorted(scores.tolist(), reverse=True)[:20]
    assert seen < 20 * sum(x is not None for x in tree.leaves) / 2


def test_large_numbers():
    n, often = np.array([10**8, 3], np.int64), np.array([10**10, 1], np.int64)
    m = [75 + 25 * x * 10**11 // 10**13 for x in n.tolist()]
    assert lexical_search.saturated(often, n, 10**11, 10**13).tolist() == [10**9 * o // (1000 * o + 12 * k) for o, k in zip(often.tolist(), m)]
