"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's normalised windows, run once over each text.

Normalised text is the words in order, each with a space on both sides; the automaton's keys are windows of `window` words
of the items (an item of fewer words is one window). Matches give word intervals, and these the offsets in the original.
Items come in blocks of a bounded number of bytes: usually one, which is one automaton and one pass over the texts. A larger
benchmark takes a pass for each block, so that the driver and each worker hold one block at a time; the passes' hits are
joined by row. A block is one item more than its bytes at most.

Defined results: null texts and texts without a word have no words and no hits; items without a word match nothing; equal
windows count for each of their items; an item without an id hits words as any other, but is not among the items listed; repeated rows and rows without an id are judged one by one, each by its own text;
other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import Tables, table

WINDOW = 10
#: Bytes of item texts in one automaton, which has a node for about every byte of its ten-fold overlapping windows: measured, a
#: worker has 222 MB with 250,000 bytes of items, 423 MB with 500,000 and 729 MB with a million.
BLOCK_BYTES = 500_000
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes: A-Z to a-z, other ASCII than letters and digits to a space, the rest as they are.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Matcher:
    """An automaton over the windows of items, (item_id, text) each."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW) -> None:
        import ahocorasick

        owners: dict[bytes, set[int]] = {}
        size: dict[bytes, int] = {}
        for item_id, text in items:
            words = words_of(text)
            for k in range(max(1, len(words) - window + 1) if words else 0):
                key = b" " + b" ".join(part := words[k : k + window]) + b" "
                owners.setdefault(key, set()).add(item_id)
                size[key] = len(part)
        self.automaton = ahocorasick.Automaton() if owners else None
        for key, ids in owners.items():
            self.automaton.add_word(key.decode("latin-1"), (size[key], tuple(ids)))
        if owners:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
        """Which words are hit; by item, its first and last hit word."""
        hit = np.zeros(len(words) + 1, np.int64)
        items: dict[int, tuple[int, int]] = {}
        if self.automaton is None or not words:
            return hit[:-1] > 0, items
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        ends = None
        for at, (n, ids) in self.automaton.iter(line):
            if ends is None:
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            last = int(np.searchsorted(ends, at))
            hit[last - n + 1] += 1
            hit[last + 1] -= 1
            for i in ids:
                a, b = items.get(i, (last, last))
                items[i] = min(a, last - n + 1), max(b, last)
        return np.cumsum(hit)[:-1] > 0, items


class Block:
    """A block of items as tasks have it: broadcast, and made into an automaton once a worker, which holds the latest only."""

    _held: tuple[str, Matcher] | None = None

    def __init__(self, spark: SparkSession, items: list[tuple[int, str]], window: int) -> None:
        self.key, self.window, self.items = uuid.uuid4().hex, window, spark.sparkContext.broadcast(items)

    def matcher(self) -> Matcher:
        if not Block._held or Block._held[0] != self.key:
            Block._held = (self.key, Matcher(self.items.value, self.window))
        return Block._held[1]


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of the runs of hit words in the original text."""
    found = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(found[a][0], found[b - 1][1]) for a, b in zip(edge[::2], edge[1::2])]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks that a worker's memory holds. They come by partitions, so that the driver holds one at a time."""
    block, size, any_ = [], 0, False
    for r in benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if size >= block_bytes:
            yield block
            block, size, any_ = [], 0, True
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block or not any_:
        yield block


def _listed(items) -> list[int]:
    return sorted(i for i in items if i is not None)


def _row(words: list[bytes], text: str, hit: np.ndarray, items: set[int]) -> tuple:
    spans = _spans(text, hit) if hit.any() else []
    return len(words), int(hit.sum()), _listed(items), [{"start": a, "end": z} for a, z in spans]


_FOUND = "n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int>>"


def _scanned(block: Block):
    """All rows of one block's pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = words_of(text)
                hit, items = block.matcher().find(words)
                rows.append(_row(words, text or "", hit, set(items)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"]).assign(doc_id=batch["doc_id"].astype("Int64").to_numpy())

    return run


def _hits(block: Block):
    """Of one block's pass, the rows with a hit: which words are hit, and the items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"]):
                hit, items = block.matcher().find(words_of(text))
                if items:
                    rows.append((key, np.flatnonzero(hit), _listed(items)))
            yield pd.DataFrame(rows, columns=["key", "words", "items"]).astype({"key": "int64"})

    return run


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, found in zip(batch["text"], batch["found"]):
            words = words_of(text)
            hit, items = np.zeros(len(words), bool), set()
            for x in found if found is not None else []:
                hit[x["words"]] = True
                items.update(x["items"])
            rows.append(_row(words, text or "", hit, items))
        yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"]).assign(doc_id=batch["doc_id"].astype("Int64").to_numpy())


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids), spans (code points of the original): one pass over the texts for a block."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = item_blocks(benchmark, block_bytes)
    block, following = next(blocks), next(blocks, None)
    columns = ["doc_id", "n_words", "n_hit", "items", "spans"]
    if following is None:
        return docs.mapInPandas(_scanned(Block(spark, block, window)), f"{_FOUND}, doc_id long").select(*columns)
    t, k, hits = Tables(spark), 0, None
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))  # rows with equal id and text have equal hits
    while block is not None:
        held = Block(spark, block, window)
        some = t.write(f"hits_{k}", keyed.select("key", "text").mapInPandas(_hits(held), "key long, words array<int>, items array<long>"))
        held.items.destroy()
        some = some.groupBy("key").agg(F.any_value(F.struct("words", "items")).alias("found"))
        hits, block, following, k = some if hits is None else hits.union(some), following, next(blocks, None), k + 1
    hits = t.write("hits", hits.groupBy("key").agg(F.collect_list("found").alias("found")))  # at most a row for each block
    return keyed.join(hits, "key", "left").select("doc_id", "text", "found").mapInPandas(_joined, f"{_FOUND}, doc_id long").select(*columns)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs whose text holds no window of any item, in the columns of docs."""

    def clean(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not block.matcher().find(words_of(text.as_py()))[1] for text in batch.column("text")]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    t, k, blocks = Tables(docs.sparkSession), 0, item_blocks(benchmark, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        docs = docs.mapInArrow(clean(Block(docs.sparkSession, block, window)), docs.schema)
        if following is not None:  # one automaton at a time
            docs = t.write(f"clean_{k}", docs)
        block, k = following, k + 1
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", F.sort_array(F.col("items").cast("array<string>")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "list_filter(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
ORACLE_SQL = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
}
QUERIES = {"op2_decontamination": op2_decontamination}
