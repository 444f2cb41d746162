from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postloom.llm import decontamination, license_scan, lm_scoring, pii, quality_classifier, quality_rules, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def words(n, seed=0):
    rng = random.Random(seed)
    return [rng.choice(["alpha", "beta", "gamma", "delta", "éte", "nine9"]) for _ in range(n)]


def loud(text):
    """ASCII letters in upper case; the operators lower-case no others."""
    return re.sub("[a-z]", lambda m: m[0].upper(), text)


# Decontamination


def brute_hits(text, items, n=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    of = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = of(text), set(), set()
    for i, t in items:
        x = of(t)
        k = min(n, len(x))
        for a in range(len(x) - k + 1 if x else 0):
            for b in range(len(w) - k + 1):
                if w[b : b + k] == x[a : a + k]:
                    hit |= set(range(b, b + k))
                    found.add(i)
    return len(w), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    items = [(1, " ".join(words(15, 1))), (2, "Alpha, BETA!"), (3, ""), (4, None), (5, " ".join(words(15, 1)) + " tail")]
    texts = [" ".join(words(30, 9)) + " " + loud(" ".join(words(15, 1))) + " " + " ".join(words(9, 3)), None, "", "  ", "alpha-beta", "betaalpha", " ".join(words(15, 1)[:9])]
    texts += [" ".join(rng.sample(words(40, 2), 30)) for _ in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (8_000_000, 20):  # one automaton, and one for each item
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontamination.scan(docs(spark, texts), bench, block_bytes=size).collect()}
        assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    spans = decontamination.scan(docs(spark, texts), bench).where("doc_id = 0").first()["spans"]
    assert any(loud(" ".join(words(15, 1))) in texts[0][s["start"] : s["end"]] for s in spans)
    assert decontamination.scan(docs(spark, []), bench).count() == 0 and decontamination.scan(docs(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_many_blocks(spark):
    """Eight blocks, and two benchmarks of one size in one session."""
    for seed in (1, 2):
        items = [(i, " ".join(words(12, 100 * seed + i))) for i in range(8)]
        texts = [f"x y z {items[k][1]} z {items[-1 - k][1]}" for k in range(4)] + [" ".join(words(60, 7)), None]
        bench = spark.createDataFrame(items, "item_id long, text string")
        for size in (10, 8_000_000):
            got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontamination.scan(docs(spark, texts), bench, block_bytes=size).collect()}
            assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
            left = decontamination.drop_contaminated(docs(spark, texts), bench, block_bytes=size)
            assert {r.doc_id for r in left.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]} and left.columns == docs(spark, []).columns


def test_decontamination_judges_rows_not_ids(spark):
    """Repeated rows, null ids, shared ids, columns with clashing names, a very long text."""
    leak = " ".join(words(10, 5))
    rows = [(1, leak, "a"), (1, leak, "a"), (1, "clean words here", "b"), (None, leak, "c"), (None, "clean", "d"), (2, "filler " * 200_000 + leak, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, items string")
    bench = spark.createDataFrame([(7, leak)], "item_id long, text string")
    for size in (8_000_000, 1):
        found = decontamination.scan(df, bench.union(bench.selectExpr("8", "'never seen'")), block_bytes=size).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.n_hit) for r in found) == [(-1, 1, 0), (-1, 10, 10), (1, 3, 0), (1, 10, 10), (1, 10, 10), (2, 200_010, 10)]
    assert sorted((r.doc_id or -1, r["items"]) for r in decontamination.drop_contaminated(df, bench).collect()) == [(-1, "d"), (1, "b")]


# Quality rules

CLEAN = "The river ran past the old mill and the children watched it turn.\nNobody had told them that the wheel was older than the town."


def test_quality_lines_and_verdicts(spark):
    texts = [CLEAN, CLEAN + "\nHome | About | News | Contact\nLicensed under CC BY 4.0.", "Home | News | About us\nShop | Help | Contact us\nTerms | Privacy | Imprint\none two three four five six.", "SHOUT! " * 20, None, "", "few words", "x y z a b " * 30]
    got = {r.doc_id: r for r in quality_rules.clean(docs(spark, texts)).collect()}
    assert got[0].text == CLEAN and got[1].text == CLEAN and got[1].n_chars == len(CLEAN) and set(got) == {0, 1}
    assert list(got[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_repeat_words_against_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a b c d e\na b c d e", None, "a\n\n a \na"]
    got = {r.doc_id: (r.a, r.b, r.c, r.d) for r in quality_rules.judged(docs(spark, texts)).selectExpr("doc_id", "__n_words a", "__n_repeat_words b", "__n_dup_lines c", "__word_chars d").collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert got[i] == (len(w), len(covered), len(lines) - len(set(lines)), sum(map(len, w)))


# License scans


def test_license_digests(spark):
    mit = license_scan.TEXTS["MIT"]
    texts = ["Copyright (c) 2020 Ann\n\n" + mit.upper().replace(",", " ,"), mit.replace("sublicense", "sub-licence"), mit + " more", "x\nlicensed under the  Apache Licence version 2.0\ny", None, ""]
    got = {r.doc_id: (r.license_id, r.notices) for r in license_scan.scan(docs(spark, texts), license_scan.known_digests(spark, license_scan.TEXTS), license_scan.known_digests(spark, license_scan.NOTICES)).collect()}
    assert got == {0: ("MIT", ""), 1: ("MIT", ""), 2: (None, ""), 3: (None, "Apache-2.0"), 4: (None, ""), 5: (None, "")}


def test_license_notices_of_any_length_and_wording(spark):
    long = "Use is granted " + "to everyone and " * 40 + "for ever."
    known = license_scan.known_digests(spark, [*license_scan.NOTICES, ("Long", long), ("PD", "In the public domain.")])
    texts = ["a\nReleased under the MIT License.\nb", f"a\n{long}\n\nb", "in the  public domain\nLicensed under the MIT Licence"]
    got = {r.doc_id: r.notices for r in license_scan.scan(docs(spark, texts), known.limit(0), known).collect()}
    assert got == {r.doc_id: r.notices for r in license_scan.scan(docs(spark, texts), known.limit(0), known, most_known=0).collect()}  # by a join
    assert got == {0: "MIT", 1: "Long", 2: "MIT,PD"}


def test_license_copyright_lines(spark):
    mit = license_scan.TEXTS["MIT"]
    forms = ["Copyright © 2020 Ann", "© 2020 Ann", "Copyright Ann 2020", "Copyright [yyyy] [name]", "# Copyright (C) Ann", "(c) Ann, 2020", " * Copyright: Ann"]
    wrapped = mit.replace("above copyright", "above\ncopyright").replace("OR COPYRIGHT", "OR\nCOPYRIGHT")  # no copyright lines
    texts = [f"{x}\n\n{mit}" for x in forms] + [wrapped, "Ann's text\n" + mit]
    known = license_scan.known_digests(spark, license_scan.TEXTS)
    got = {r.doc_id: r.license_id for r in license_scan.scan(docs(spark, texts), known, known.limit(0)).collect()}
    assert got == {i: "MIT" for i in range(len(forms) + 1)} | {len(forms) + 1: None}


def test_license_defined_cases(spark):
    known, notices = license_scan.known_digests(spark, license_scan.TEXTS), license_scan.known_digests(spark, license_scan.NOTICES)
    mit = license_scan.TEXTS["MIT"]
    rows = [(None, mit, "a"), (1, mit, "a"), (1, mit, "a"), (2, None, "b"), (3, " ", "c"), (4, "x" * 100_000 + "\nReleased under the MIT licence", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, notices string")
    for most in (1000, 0):
        got = sorted((r.doc_id or -1, r.license_id, r.notices) for r in license_scan.scan(df, known, notices, most).collect())
        assert got == [(-1, "MIT", ""), (1, "MIT", ""), (1, "MIT", ""), (2, None, ""), (3, None, ""), (4, None, "MIT")]
        assert license_scan.scan(df.limit(0), known, notices, most).count() == 0


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if holds(kind, m[0]))


def test_base_spans_against_python(spark):
    rng = random.Random(11)
    parts = ["a@b.co", "a@b.co_d@e.fr", "x.y+z@h-1.org.", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12345", " ", "\n", "é🙂", "word", "00255.1.2.3", "%", "_", "..", "+", "--", "5500000000000004"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 9))) for _ in range(250)] + [None, "", "1" * 20_000, "a" * 20_000 + "@x", "7 " * 9000]
    got = {r.doc_id: r for r in pii.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        line = ",".join(f"{list(PATTERNS)[k]}:{a}:{z}" for a, k, z in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))


def test_redaction_and_loose_spans(spark):
    texts = ["Write to ann@x.org or call +44 20 7946 0958 now."] + ["contact me: bob (at) mail (dot) com please"] * 3 + ["call (555) 123-4567 today"] * 5 + ["nothing here", None]
    out = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert out[0] == "Write to <EMAIL> or call <PHONE> now." and out[9] == "nothing here" and out[10] is None
    assert "<EMAIL>" in out[1] and out[4] == "call <PHONE> today"


def test_votes_decide_loose_spans(spark):
    """Secrets are added; long names and card numbers that fail the checksum are not; nothing is without the votes."""
    key = "ab12" * 10
    texts = [f'set token = "{key}" here'] * 6 + ["the number 4111111111111112 is one"] * 6 + ["call_of_the_very_long_identifier_1 again"] * 3 + ["+1 (555) 123-4567 rings"] * 3
    got = {r.doc_id: (r.spans, r.secrets) for r in pii.digest(docs(spark, texts)).collect()}
    assert got == {i: ("", "secret:13:53") if i < 6 else ("phone:0:17" if i > 14 else "", "") for i in range(len(texts))}
    found = pii.candidates(docs(spark, texts)).cache()
    assert all(r.n == 0 for r in pii.spans(found, np.zeros(100)).where("doc_id < 15").selectExpr("size(__spans) AS n").collect())
    assert found.where("doc_id > 14").selectExpr("max(size(__c)) AS n").first().n == 1  # no fragment of a base span


def test_reliabilities_against_simulated_labelers():
    """Labelers of known reliability: the estimates come near, whatever the size of the corpus."""
    rng = np.random.default_rng(1)
    n = 40_000
    truth = rng.random(n) < 0.4
    right = {"v1": 0.9, "v2": 0.8, "v3": 0.95, "v4": 0.7}
    votes = {v: np.where(rng.random(n) < p, truth, ~truth) for v, p in right.items()}
    counts = Counter(zip(*[np.where(votes[v], 1, 2).tolist() for v in right]))
    for times in (1, 1000, 10**9):
        rows = [{"kind": 0, "strict": False, "v0": 0, **dict(zip(right, k)), "shape": 0, "n": c * times} for k, c in sorted(counts.items())]
        rates, post = pii.reliabilities(rows)
        for j, (v, p) in enumerate(right.items(), 1):
            assert abs(rates[0, j, 1, 1] - p) < 0.03 and abs(rates[0, j, 0, 2] - p) < 0.03
        w = pii.classifier(rows, post)
        score = np.array([pii._features(r) for r in rows]) @ w
        exact = [sum(np.log(p / (1 - p)) * (1 if r[v] == 1 else -1) for v, p in right.items()) + np.log(0.4 / 0.6) for r in rows]
        assert all((a > 0) == (b > 0) for a, b in zip(score, exact) if abs(b) > 0.5)


def test_digest_defined_cases(spark):
    rows = [(None, "a@b.co", "x"), (1, "a@b.co", "x"), (1, "a@b.co", "x"), (2, None, "y"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    assert sorted((r.doc_id or -1, r.n_email, r.spans) for r in pii.digest(df).collect()) == [(-1, 1, "email:0:6"), (1, 1, "email:0:6"), (1, 1, "email:0:6"), (2, 0, ""), (3, 0, "")]
    assert pii.digest(df.limit(0)).count() == 0 and pii.redact(df).columns == df.columns and pii.redact(df.limit(0)).count() == 0


# Sharding


def test_schedule_is_balanced_and_whole(spark):
    rng = random.Random(5)
    texts = ["x" * rng.randint(0, 400) for _ in range(400)] + ["same"] * 50 + [None, "", ""]
    got = sharding.shard(docs(spark, texts), 8).toPandas()
    assert len(got) == len(texts)
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 0.02 * load.sum()
    by_text = {i: t or "" for i, t in enumerate(texts)}
    assert got.assign(t=got["doc_id"].map(by_text)).groupby("t")["shard"].nunique().max() == 1
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    assert sharding.shard(docs(spark, [])).count() == 0
    assert sharding.schedule([(5, 0), (4, 1), (3, 2), (3, 3)], 2) == {0: 0, 1: 1, 2: 1, 3: 0}


def test_shards_against_brute_force(spark):
    """All groups are units, so the result is the whole schedule: the largest first, each to the least loaded."""
    rng = random.Random(7)
    texts = ["x" * rng.randint(0, 60) + str(rng.randint(0, 3)) for _ in range(300)] + [None, ""]
    size: Counter = Counter()
    for t in texts:
        size[hashlib.md5((t or "").encode()).hexdigest()] += len(t or "") + 1
    load, to = [0] * 5, {}
    for group in sorted(size, key=lambda g: (-size[g], g)):
        to[group] = min(range(5), key=lambda s: (load[s], s))
        load[to[group]] += size[group]
    rows = [(i % 200 or None, t, 1) for i, t in enumerate(texts)]  # repeated and null ids, a clashing column
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 5, parts=10**6).collect()
    assert Counter((r.doc_id, r.size, r.shard) for r in got) == Counter((i, len(t or "") + 1, to[hashlib.md5((t or "").encode()).hexdigest()]) for i, t, _ in rows)


# Language model


def test_changed_documents_fail():
    k = lm_scoring.Keys(["one two", "three"], np.ones(2, bool), np.ones(2, bool))
    other = lm_scoring.Keys(["one two", "trois"], np.ones(2, bool), np.ones(2, bool))
    answer = lambda x: lm_scoring._answer(pd.DataFrame([(0, 1, x.keys.tobytes(), lm_scoring._packed(x.learned, x.deleted))], columns=["part", "block", "keys", "counts"]))
    answers = answer(k)
    assert (lm_scoring._total(k, answers[answers["block"] == 1], "every", 1)[0] == k.learned).all()
    with pytest.raises(RuntimeError):
        lm_scoring._total(other, answers[answers["block"] == 1], "every", 1)


def test_scores_defined_cases(spark):
    """Null and repeated ids, clashing columns, a very long text, more parts than partitions."""
    rows = [(None, "a b", 1), (None, "a b", 1), (1, "a b c " * 50_000, 2), (2, None, 3), (2, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learned int")
    got = lm_scoring.score(df).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 3), (-1, 3), (1, 150_001), (2, 1), (2, 1)]
    assert len({r.score for r in got if r.doc_id is None}) == 1 and len({r.score for r in got if r.doc_id == 2}) == 1


def brute_scores(rows, block_weights):
    import math
    import zlib

    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    toks = {i: re.findall("[^\x20\x09-\x0d]+", low(t)) + ["\0end"] for i, t in rows}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    uni, bi = Counter(), Counter()
    for i in train:
        uni.update(toks[i])
        bi.update(zip(["\0end", *toks[i]], toks[i]))
    n, v = sum(uni.values()), len(uni)
    out = {}
    for i, w in toks.items():
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        total = 0.0
        for a, b in zip(["\0end", *w], w):
            c = uni[a]
            s = block_weights[0 if not c else min(1 + int(math.log2(c)), len(block_weights) - 1)]
            total += math.log10(s[0] * bi[a, b] / max(c, 1) + s[1] * uni[b] / n + s[2] / (v + 1))
        out[i] = (len(w), sum(x in uni for x in w), n, base, total)
    return out


def test_scores_against_brute_force(spark):
    texts = [" ".join(words(random.Random(i).randint(0, 40), i)) for i in range(60)] + [None, "", "Never seen words"]
    told = {}
    got = {r.doc_id: r for r in lm_scoring.score(docs(spark, texts).repartition(3).checkpoint(), block=7, report=told.update).collect()}
    want = brute_scores([*enumerate(texts)], told["weights"])
    for i, (n, known, tokens, base, total) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(total)
    assert abs(told["weights"].sum(1) - 1).max() < 1e-9 and (told["weights"][1:] > 0).all()
    assert lm_scoring.score(docs(spark, [])).count() == 0


# Quality classifier


def test_rules_of_a_forest():
    printed = "RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 2 <= 0.5)\n     If (feature 1 <= 3.0)\n      Predict: 0.0\n     Else (feature 1 > 3.0)\n      Predict: 1.0\n    Else (feature 2 > 0.5)\n     Predict: 1.0\n"
    assert set(quality_classifier.rules_of(printed)) == {((2, True, 0.5),), ((1, True, 3.0), (2, True, 0.5)), ((1, False, 3.0), (2, True, 0.5)), ((2, False, 0.5),)}


def test_statistics_and_compiled_score_against_brute_force(spark):
    texts = ["one two two Three.\nfour, five!\n\nfour, five!", "A|B | 12 && ñ", "", None, "x" * 50_000]
    frame, names = quality_classifier.with_statistics(docs(spark, texts))
    got = {r.doc_id: r for r in frame.collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w, lines, chars = re.findall("[^\x20\x09-\x0d]+", t), [x for x in t.split("\n") if x], max(len(t), 1)
        share = lambda p: len(re.findall(p, t)) / chars
        want = {
            "words": len(w), "word_length": sum(map(len, w)) / max(len(w), 1), "distinct": len(set(w)) / max(len(w), 1), "echoes": sum(a == b for a, b in zip(w, w[1:])) / max(len(w), 1), "symbols": share(r"[#*$%&<>~^=+@_\\]"),
            "bars": share("[|]"), "stops": share("[.]"), "commas": share("[,;:]"), "marks": share("[!?]"), "capitals": share("[A-Z]"), "digits": share("[0-9]"), "line_words": len(w) / max(len(lines), 1), "line_repeats": 1 - len(set(lines)) / max(len(lines), 1),
        }
        assert all(got[i][f"_{k}"] == pytest.approx(v) for k, v in want.items()), (t[:40], want, got[i])
    weighted = [(((0, False, 2.0), (9, False, 0.0)), 1.5), (((0, True, 3.0),), -0.75)]
    for r in frame.select("doc_id", *names, quality_classifier.compiled(0.25, weighted, names).alias("score")).collect():
        fired = [all(r[names[k]] <= b if below else r[names[k]] > b for k, below, b in rule) * weight for rule, weight in weighted]
        assert r.score == pytest.approx(1 / (1 + np.exp(-0.25 - sum(fired))))


def test_classifier_defined_cases(spark):
    rows = [(None, "a b", 1), (1, "a b", 1), (1, "a b", 1), (2, None, 0), (3, "y " * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    one_class = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int")
    got = quality_classifier.classify(df, one_class).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1 and 0.5 < got[0].score < 1


def test_classifier_on_held_out(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["river", "mill", "children", "watched", "turning", "slowly"]) for _ in range(40)) + "."
    bad = lambda: " ".join(["buy"] * 20 + ["NOW!!!"] * 10)
    texts = [good() if i % 2 else bad() for i in range(300)] + [None, ""]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(docs(spark, texts), labels).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert held and sum(got[i].predicted == i % 2 for i in held) >= 0.95 * len(held)
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got.values())
    none = quality_classifier.classify(docs(spark, texts), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and quality_classifier.classify(docs(spark, []), labels).count() == 0


def test_extra_columns_do_not_clash(spark):
    """Names that the operators use themselves keep their values."""
    from postloom.llm import near_dedup

    names = ["n", "c", "rep", "__row", "__c", "__text", "__base", "__more", "__kept", "__spans", "__words", "__lines", "__hash", "__clean", "__key", "__first", "__n", "key", "cls", "kept"]
    df = docs(spark, [CLEAN]).withColumns({n: F.lit(n) for n in names})
    for f in (quality_rules.clean, pii.redact, near_dedup.deduplicate):
        got = f(df)
        assert got.columns == df.columns
        assert [got.first()[n] for n in names] == names


def test_numbers_that_fail_the_checksum_are_no_cards(spark):
    """However few rows there are: what votes for them can't make up for it."""
    bad = "pay with card 4731080387325255 now"
    for texts in ([bad], [bad] * 3 + ["card 4111111111111111"], [bad + " and visa card 5731080387325257"] * 40):
        assert all("card" not in (r.spans or "") or "4111" in t for r, t in zip(sorted(pii.digest(docs(spark, texts)).collect(), key=lambda r: r.doc_id), texts))


def test_items_without_an_id_hit_words(spark):
    leak = " ".join(words(12, 3))
    bench = spark.createDataFrame([(None, leak), (4, "other words entirely"), (5, None)], "item_id long, text string")
    rows = docs(spark, [f"before {leak} after", "clean text of its own", None, leak * 3000])
    for block in (10, 500_000):
        got = {r.doc_id: r for r in decontamination.scan(rows, bench, block_bytes=block).collect()}
        assert got[0].n_hit == 12 and got[0]["items"] == [] and len(got[0].spans) == 1 and got[1].n_hit == 0 and got[3].n_hit > 0
        assert sorted(r.doc_id for r in decontamination.drop_contaminated(rows, bench, block_bytes=block).collect()) == [1, 2]
