from __future__ import annotations

import random
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postloom.llm import packing, token_counts

PIECES = ["a", "b", " ", "\n", "'", "ll", "'re", "é", "́", "日本", "\t", "!!", "12", " the", "<|endoftext|>", " ", "\x1c", "　", "don't", "I've", "ß", "🙂", "\r\n", "<|endof", "  ", "therefore", "\0", "\x85"]


def texts(n, seed=0, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("limit", [0, 1, 3, 8])
def test_every_prefix_has_the_library_count(limit):
    c = token_counts.PrefixCounter()
    given = texts(250, limit)
    tokens, fit = c.budgets(pa.array(given), limit)
    for k, t in enumerate(given):
        want = [len(c.library.encode(t[: i + 1], add_special_tokens=False).ids) for i in range(len(t))]
        assert list(c.counts(t)) == want
        assert tokens[k] == (want[-1] if want else 0)
        assert fit[k] == max([i + 1 for i, n in enumerate(want) if n <= limit], default=0)


def test_budgets_come_from_prefix_tables():
    """Without the library's encoding, of which only the division into words is left."""
    c = token_counts.PrefixCounter()
    rng = random.Random(3)
    parts = ["the", "therefore", "don't", "I've", "日本é", "x\ny", "12,5!", "🙂", "ß"]
    given = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["", " the", "the "]
    want = [[len(c.library.encode(t[: i + 1], add_special_tokens=False).ids) for i in range(len(t))] for t in given]
    c.library = types.SimpleNamespace(pre_tokenizer=c.library.pre_tokenizer)
    tokens, fit = c.budgets(pa.array(given), 6)
    assert tokens.tolist() == [w[-1] if w else 0 for w in want]
    assert fit.tolist() == [max([i + 1 for i, n in enumerate(w) if n <= 6], default=0) for w in want]
    assert c.later.keys() >= {w for t in given for w in t.split(" ")[1:]}


def test_token_budget_defined_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "hello world", 1), (3, "word " * 3000, 1), (3, "word " * 3000, 1)]
    got = token_counts.token_budget(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), 1024).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(-1, 11, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, 15000, 3001, True), (3, 15000, 3001, True)]
    assert {r.fit_chars for r in got if r.over_limit} == {len("word " * 1024) - 1}
    assert token_counts.prefix_counts(spark.createDataFrame([(1, "ab c")], "doc_id long, text string")).first()["counts"] == [1, 1, 2, 2]
    assert token_counts.token_budget(spark.createDataFrame([], "doc_id long, text string"), 5).count() == 0


def test_word_ids_are_the_library_ids():
    w = packing.WordIds()
    given = texts(400, 5)
    ids, begins = w.encode(pa.array(given))
    for k, t in enumerate(given):
        assert ids[begins[k] : begins[k + 1]].tolist() == w.library.encode(t, add_special_tokens=False).ids


def test_ids_do_not_depend_on_the_batch():
    """Special strings in any case, alone and beside texts with combining marks."""
    w = packing.WordIds()
    given = ["<|ENDOFTEXT|> x", "<|endoftext|> X", "a<|EndOfText|>b", "<|startoftext|>", "<| Endoftext |>", "He said STOP", "e\u0301E\u0301 <|ENDOFTEXT|>", "É E\u0301 é", None]
    want = [w.library.encode(t or "", add_special_tokens=False).ids for t in given]
    for batch in ([k] for k in range(len(given))), [list(range(len(given)))], [[0, 7], [7, 0, 1], [2, 3, 8, 6]]:
        for at in batch:
            ids, begins = w.encode(pa.array([given[k] for k in at], pa.string()))
            assert [ids[a:z].tolist() for a, z in zip(begins, begins[1:])] == [want[k] for k in at]


def test_pieces_against_the_library(spark):
    """All rows of the query on small tables: ids, lengths, starts and places, text by text."""
    import zlib

    sf = "/root/testdata/sf0.001"
    library = packing.WordIds().library
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[r.doc_id, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    got = packing.op1_best_fit_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in bins.values():
        spots.sort()
        assert [a for a, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))] and sum(n for _, n in spots) <= 2048
    assert len(bins) <= -(-sum(n for _, n, _ in want.values()) // 2048) + 1  # one more than their tokens need, at most


def test_sequences_keep_every_row(spark):
    rows = [(None, "one two"), (None, "one two"), (None, "three"), (1, None), (1, "one two"), (1, "one two")]
    got = packing.sequences(spark.createDataFrame(rows, "doc_id long, text string"), capacity=8).collect()
    library = packing.WordIds().library
    want = sorted(i for _, t in rows for i in [*library.encode(t or "", add_special_tokens=False).ids, 0])
    assert sorted(i for r in got for i in r.ids) == want and sorted(str(d) for r in got for d in r.doc_ids) == sorted(str(d) for d, _ in rows)


@pytest.mark.parametrize("kept", [0, 5, 60])
def test_word_ids_survive_forgetting(kept):
    """Batches whose words are all new, all known, or known before the cache began anew."""
    w, library = packing.WordIds(kept=kept), packing.WordIds().library
    batches = [["one two three", "four five six seven"], ["alpha beta"], ["alpha beta", "one Two, three..."], ["H\u0331e H\u0331E He", "STOP! stop!? It's, I'LL"], [""], [None, "beta alpha"], *[texts(40, k) for k in range(8)], ["one two"]]
    for given in batches:
        ids, begins = w.encode(pa.array(given, pa.string()))
        for k, t in enumerate(given):
            assert ids[begins[k] : begins[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kept", [0, 5])
def test_prefix_tables_survive_forgetting(kept, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_TOTALS", kept)
    c = token_counts.PrefixCounter(kept=kept)
    for given in [["one two three four five six seven"], ["alpha beta"], ["alpha beta", "one two three"], *[texts(40, k) for k in range(6)]]:
        tokens, _ = c.budgets(pa.array(given), 4)
        assert tokens.tolist() == [len(c.library.encode(t, add_special_tokens=False).ids) for t in given]


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(150):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        items, sums = [n for n, c in counts.items() for _ in range(c)], {0}
        for n in items:
            sums |= {s + n for s in sums if s + n <= room}
        got = packing.fullest(counts, room)
        assert sum(n * k for n, k in got.items()) == max(sums) and all(k <= counts[n] for n, k in got.items())


def test_plan_places_everything():
    rng = random.Random(2)
    histogram = {rng.randint(1, 200): rng.randint(1, 40) for _ in range(120)}
    bins = packing.plan(histogram, 200)
    used: dict[int, int] = {}
    for b, times in bins:
        assert sum(n * k for n, k in b.items()) <= 200
        for n, k in b.items():
            used[n] = used.get(n, 0) + k * times
    assert used == histogram
    free: list[int] = []  # first fit decreasing
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        k = next((k for k, room in enumerate(free) if room >= n), None)
        if k is None:
            free.append(200 - n)
        else:
            free[k] -= n
    assert sum(t for _, t in bins) <= len(free)


def test_packed_sequences_have_no_gap(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(0, 400), "x") for i in range(120)] + [(500, "word " * 5000, "x"), (501, None, "x"), (None, "a b", "x"), (7, "same", "x"), (7, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(docs).toPandas()
    assert got["length"].sum() == sum(len((t or "").split()) + 1 for _, t, _ in rows) and got["length"].max() <= 2048
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.concatenate([[0], s["length"].cumsum()[:-1]])).all() and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() == -(-got["length"].sum() // 2048)
    long = got[got["doc_id"] == 500].sort_values("piece")
    assert long["length"].tolist() == [2048, 2048, 905] and long["start"].tolist() == [0, 2048, 4096]
    word = packing.WordIds().encode(pa.array(["word"]))[0].tolist()
    assert got[got["doc_id"] == 501]["ids_crc32"].tolist() == [zlib.crc32(b"\0\0\0\0")]
    seqs = packing.sequences(docs.where("doc_id = 500"), capacity=2048).collect()
    assert sorted(i for s in seqs for i in s["ids"]) == sorted(word * 5000 + [0]) and all(len(s["ids"]) <= 2048 for s in seqs)
    assert packing.pack(docs.where(F.lit(False))).count() == 0
