"""Language-model scores by deleted interpolation of n-gram estimates.

The probability of a token after another mixes the maximum-likelihood bigram, the unigram and a uniform share; the mixture
weights depend on how often the context was seen (buckets by powers of two) and are learned by expectation-maximisation on
held-out training counts: a fifth of the documents, whose own counts are deleted from the estimates while weights are learned.

Counts are exact and cover all training documents, yet no row is made for a token. Documents are taken in blocks (runs of
rows of an input partition). A block asks for the counts of its distinct tokens and bigrams, and says its own counts with
the question; the questions, dealt by the hash of what is asked for, are summed and answered; the answers come back to the
block, which scores its texts. A very common token is asked for once a block, so no key is hot. Tokens and bigrams are
64-bit hashes.

docs must give the same rows in the same partitions when read again, as a table scan or a checkpoint does; a block whose
keys changed fails instead of scoring wrongly: answers carry the sum of the keys that they answer.

Defined results: a null or empty text is one token, the end; a null id counts as the empty text in the choice of training
documents; repeated rows count and are scored each; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import cut, mix, partitions, table, word_hashes

#: Rows of one block.
BLOCK = 4096
#: Bytes of text whose keys make a part, of which a task sums one at a time.
PART_BYTES = 64_000_000
FOLDS = 5
HELD_OUT, DELETED = 1, 0  # remainders of crc32(id): never learned from; learned from, and used for the weights
BUCKETS = 24
ROUNDS = 60
_U = np.uint64
_END = mix(np.array([0x5EED], _U))
_CONTEXT = _U(0xA24BAED4963EE407)


class Keys:
    """The distinct tokens (even numbers) and bigrams (odd numbers) of a block's documents, with their counts in it."""

    def __init__(self, texts: list[str | None], learned: np.ndarray, deleted: np.ndarray) -> None:
        tokens = [np.concatenate([word_hashes(t), _END]) for t in texts]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.doc = np.repeat(np.arange(len(tokens)), self.sizes)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, _U)
        before = np.concatenate([_END, flat[:-1]])[: len(flat)]  # the last token of the document before is an end
        both = np.concatenate([flat & ~_U(1), mix(mix(before + _CONTEXT) ^ flat) | _U(1)])
        self.keys, inverse = np.unique(both, return_inverse=True)
        n = len(flat)
        self.token, self.bigram = inverse[:n], inverse[n:]
        end = np.searchsorted(self.keys, _END[0] & ~_U(1))
        self.context = np.concatenate([[end], self.token[:-1]])[:n]
        count = lambda w: np.bincount(inverse, np.concatenate([w[self.doc]] * 2).astype(np.float64), len(self.keys)).astype(np.int64)
        self.learned, self.deleted = count(learned), count(deleted)


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the hash's range begins in sorted keys."""
    first = np.array([-(-(p << 32) // parts) << 32 for p in range(parts)], _U)
    return np.append(np.searchsorted(keys, first), len(keys))


def _packed(*columns: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate(columns).astype("<u4").tobytes(), 1)


def _unpacked(blob: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64).reshape(columns, -1)


def _ask(parts: int):
    """Rows of (part, block, keys, counts): what a block asks and its own counts of it."""

    def rows(block: int, held: list[pd.DataFrame]) -> pd.DataFrame:
        docs = pd.concat(held)
        k = Keys(docs["text"].tolist(), docs["learned"].to_numpy(bool), docs["deleted"].to_numpy(bool))
        cuts = _bounds(k.keys, parts)
        out = [(p, block, k.keys[a:z].tobytes(), _packed(k.learned[a:z], k.deleted[a:z])) for p, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
        return pd.DataFrame(out, columns=["part", "block", "keys", "counts"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = None, []
        for b in batches:
            for now, docs in b.groupby("block", sort=False):
                if now != block and held:
                    yield rows(block, held)
                    held = []
                block = now
                held.append(docs)
        if held:
            yield rows(block, held)

    return run


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """What all other blocks have of what each block asked: for all its keys, and for those of its deleted documents.

    One more row has the sums over the part's distinct tokens.
    """
    keys = [np.frombuffer(x, _U) for x in rows["keys"]]
    own = [_unpacked(x, 2) for x in rows["counts"]]
    known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    learned, deleted = (np.bincount(inverse, np.concatenate([x[i] for x in own]).astype(np.float64), len(known)).astype(np.int64) for i in (0, 1))
    out, at = [], 0
    for block, k, (a, b) in zip(rows["block"], keys, own):
        spot = inverse[at : at + len(k)]
        at += len(k)
        rest = learned[spot] - a, deleted[spot] - b
        out.append((block, int(rows["part"].iloc[0]), _packed(*rest), _packed(*(x[b > 0] for x in rest)), 0, 0, 0, _sum(k), _sum(k[b > 0])))
    token = (known & _U(1)) == 0
    out.append((-1, int(rows["part"].iloc[0]), None, None, int(learned[token].sum()), int((learned[token] > 0).sum()), int(deleted[token].sum()), 0, 0))
    return pd.DataFrame(out, columns=["block", "part", "every", "held", "tokens", "distinct", "deleted", "every_sum", "held_sum"])


def _sum(keys: np.ndarray) -> int:
    return int(mix(keys).sum(dtype=_U).astype(np.int64))


def _total(keys: Keys, answers: pd.DataFrame, column: str, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all documents, of the block's keys: learned and deleted."""
    cuts = _bounds(keys.keys, parts)
    learned, deleted = keys.learned.copy(), keys.deleted.copy()
    got, sums = dict(zip(answers["part"], answers[column])), dict(zip(answers["part"], answers[f"{column}_sum"]))
    for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
        if z > a:
            rest = _unpacked(got[p], 2) if p in got else np.zeros((2, 0), np.int64)
            if rest.shape[1] != z - a or sums[p] != _sum(keys.keys[a:z]):
                raise RuntimeError("a block's documents are not those that it asked for: read docs from a table or a checkpoint")
            learned[a:z] += rest[0]
            deleted[a:z] += rest[1]
    return learned, deleted


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then by powers of two of its count."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)


def weights(cells: pd.DataFrame, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """By bucket, the shares of bigram, unigram and uniform estimates, by expectation-maximisation over weighted cells.

    cells: bucket, n (tokens), and their summed bigram and unigram estimates. A count for each share keeps all above 0.
    """
    out = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    out[0] = [0, 0.8, 0.2]
    if not len(cells):
        return out
    n, at = cells["n"].to_numpy(float), cells["bucket"].to_numpy(int)
    p = np.stack([cells["p2"].to_numpy(float) / n, cells["p1"].to_numpy(float) / n, np.full(len(n), uniform)], 1)
    prior = out.copy()
    for _ in range(rounds):
        share = out[at] * p
        share *= (n / share.sum(1))[:, None]
        sums = np.stack([np.bincount(at, share[:, k], BUCKETS) for k in range(3)], 1) + prior
        out = sums / sums.sum(1, keepdims=True)
    return out


def _cells(parts: int, tokens: int):
    """Of the deleted documents: tokens by bucket and rounded estimates, learned without the deleted documents."""

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        yes = np.ones(len(docs), bool)
        k = Keys([zlib.decompress(x).decode("utf-8", "surrogatepass") for x in docs["packed"]], yes, yes)
        learned, deleted = _total(k, answers, "held", parts)
        left = learned - deleted
        context = left[k.context]
        p2, p1 = left[k.bigram] / np.maximum(context, 1), left[k.token] / max(tokens, 1)
        step = lambda p: np.where(p > 0, np.round(-2 * np.log2(np.maximum(p, 1e-30))), -1).astype(np.int64)
        out = pd.DataFrame({"bucket": bucket(context), "q2": step(p2), "q1": step(p1), "p2": p2, "p1": p1, "n": 1.0})
        return out.groupby(["bucket", "q2", "q1"], as_index=False).sum()

    return run


def _scores(parts: int, tokens: int, distinct: int, share: np.ndarray):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        k = Keys([zlib.decompress(x).decode("utf-8", "surrogatepass") for x in docs["packed"]], docs["learned"].to_numpy(bool), docs["deleted"].to_numpy(bool))
        learned, _ = _total(k, answers, "every", parts)
        count, context = learned[k.token], learned[k.context]
        s = share[bucket(context)]
        p = s[:, 0] * (learned[k.bigram] / np.maximum(context, 1)) + s[:, 1] * (count / max(tokens, 1)) + s[:, 2] / (distinct + 1)
        by_doc = lambda x: np.bincount(k.doc, x, len(docs))
        return pd.DataFrame({
            "doc_id": docs["doc_id"].to_numpy(), "held_out": ~docs["learned"].to_numpy(bool), "n_tokens": k.sizes, "n_known": by_doc(count > 0).astype(np.int64), "train_tokens": tokens,
            "base_score": by_doc(np.log10((count + 0.5) / (tokens + 0.5 * (distinct + 1)))), "score": by_doc(np.log10(p)),
        }).astype({"doc_id": "Int64"})

    return run


def _pack_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["packed"] = [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in b["text"]]
        yield b.drop(columns="text")


def score(docs: DataFrame, block: int = BLOCK, report: Callable[[dict], None] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams) and score (log10 of the mixture)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), -(-size // PART_BYTES))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    row = F.monotonically_increasing_id()
    runs = F.spark_partition_id().cast("long") * F.lit(1 << 33) + F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / block)
    docs = docs.select(F.col("doc_id").cast("long"), "text", (fold != HELD_OUT).alias("learned"), (fold == DELETED).alias("deleted"), runs.alias("block"))
    asked = docs.mapInPandas(_ask(parts), "part int, block long, keys binary, counts binary")
    answers = cut(asked.groupBy("part").applyInPandas(_answer, "block long, part int, every binary, held binary, tokens long, distinct long, deleted long, every_sum long, held_sum long"))
    sums = answers.where("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "deleted")]).first()
    tokens, distinct = sums["tokens"], sums["distinct"]
    packed = docs.mapInPandas(_pack_texts, "doc_id long, learned boolean, deleted boolean, block long, packed binary")
    to_blocks = answers.where("block >= 0")
    cells = (
        docs.where("deleted").mapInPandas(_pack_texts, packed.schema).groupBy("block").cogroup(to_blocks.select("block", "part", "held", "held_sum").groupBy("block"))
        .applyInPandas(_skipped(_cells(parts, tokens - sums["deleted"])), "bucket long, q2 long, q1 long, p2 double, p1 double, n double")
        .groupBy("bucket", "q2", "q1").agg(*[F.sum(c).alias(c) for c in ("p2", "p1", "n")])
    )  # at most a cell for each bucket and pair of rounded estimates
    share = weights(cells.select("bucket", "p2", "p1", "n").toPandas().sort_values(["bucket", "p2", "p1"]), 1 / (distinct + 1))
    if report:
        report({"tokens": tokens, "distinct": distinct, "weights": share})
    scored = packed.groupBy("block").cogroup(to_blocks.select("block", "part", "every", "every_sum").groupBy("block"))
    return scored.applyInPandas(_skipped(_scores(parts, tokens, distinct, share)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _skipped(f):
    """Without the blocks that have no document on the left."""
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return f(docs, answers) if len(docs) else pd.DataFrame()

    return run


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
