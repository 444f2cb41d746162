"""Ranked lexical search: exact sparse inner products by ball trees.

A document is a point: for each term of the searched items, the term's weight times its saturated frequency. An item is the
vector of its terms' repeats, so a score is an inner product. Each task makes ball trees over its documents, thousands at a
time. A node has its points' centroid and radius; by Cauchy and Schwarz no point of it scores above q.c + |q| r. A radius spans
all terms, an item's few included, so a node also has its highest entry of each term, and no point scores above those of the
item's terms; the lower of both bounds counts, rounded up beyond any error of doubles. An item visits nodes best first and
leaves all those whose bound is below its twentieth score so far, which goes on from tree to tree within a task. Leaves are
scored in 64-bit integers. Tasks give their best for each item, and the best of these are the result: nothing grows with the
documents but the points, which stay where they are.

Points only have the terms of the items at hand, which come in blocks of a bounded number of distinct terms; a block takes one
pass over the texts. A block with more terms is a single item of that many.

Defined results: a null or empty text has no terms; it is not counted and never found. An item without terms, or whose terms
no document has, has no rows. Repeated documents are ranked one by one; a null doc_id comes after all others of its score;
repeated items and null item ids are answered one by one. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.common import Tables, table

TOP = 20
#: Distinct terms, and items, of one block.
TERMS, ITEMS = 8_192, 4_096
#: Documents and their term entries in one tree, and documents in a leaf.
TREE, ENTRIES, LEAF = 16_384, 2_000_000, 64
#: Bytes of text whose words are made at once.
PIECE = 4_000_000
#: Relative errors that bounds allow for; those of doubles are below 1e-11 for as many terms as a block has.
SLACK = 1e-9
#: Bytes: A-Z to a-z, other ASCII than letters and digits to a space, the rest as they are.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(text: str | None) -> Counter:
    """How often a text has each of its terms."""
    data, at, out = (text or "").encode("utf-8", "surrogatepass").translate(_TERM), 0, Counter()
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


class Items:
    """A block of items: their ids, and their terms as places in the block's vocabulary, with repeats."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.terms: list[np.ndarray] = []
        self.repeats: list[np.ndarray] = []

    def add(self, item_id: int | None, counts: Counter) -> None:
        self.ids.append(item_id)
        self.terms.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in counts], np.int64))
        self.repeats.append(np.array(list(counts.values()), np.int64))

    def full(self, counts: Counter) -> bool:
        return len(self.ids) >= ITEMS or bool(self.ids) and len(self.vocabulary) + sum(t not in self.vocabulary for t in counts) > TERMS


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items that have terms, in blocks; the driver reads them by partitions and holds one block."""
    block = Items()
    for r in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        counts = term_counts(r["text"])
        if not counts:
            continue
        if block.full(counts):
            yield block
            block = Items()
        block.add(r["item_id"], counts)
    if block.ids:
        yield block


def _points(items):
    """Of each document with terms: its terms' number, and places and frequencies of those that the items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = items.value.vocabulary
        for b in batches:
            keep, n, terms, often = [], [], [], []
            for k, text in enumerate(b.column("text")):
                counts = term_counts(text.as_py())
                if counts:
                    known = counts.keys() & vocabulary.keys()
                    keep.append(k), n.append(counts.total())
                    terms.append(np.array([vocabulary[t] for t in known], "<u4").tobytes())
                    often.append(np.array([counts[t] for t in known], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(often, pa.binary())], ["doc_id", "n", "terms", "often"])

    return run


def _frequencies(size: int):
    """A task's document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), "<u4"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    return run


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b in 64-bit integers where they hold it, else in Python's."""
    return a * b if int(a.max(initial=0)) * b < 1 << 63 else a.astype(object) * b


class Points:
    """Documents as rows of integer entries, in the order of their ids."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, begins: np.ndarray, terms: np.ndarray, entries: np.ndarray) -> None:
        self.ids, self.none, self.begins, self.terms, self.entries = ids, none, begins, terms, entries

    def take(self, rows: np.ndarray) -> Points:
        size = np.diff(self.begins)[rows]
        begins = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.begins[rows] - begins[:-1], size) + np.arange(begins[-1])
        return Points(self.ids[rows], self.none[rows], begins, self.terms[at], self.entries[at])

    def dot(self, dense: np.ndarray, weighted: np.ndarray) -> np.ndarray:
        """Inner products of weighted rows with a dense vector."""
        return np.add.reduceat(weighted * dense[self.terms], self.begins[:-1])


class BallTree:
    """A tree over points, none of them without entries. Nodes are numbered from the root; rows are in the order of leaves."""

    def __init__(self, points: Points, weight: np.ndarray) -> None:
        self.weight, self.centres, self.peaks, self.radii, self.children, self.leaves = weight, [], [], [], [], []
        parts: list[np.ndarray] = []
        todo, done = [(points, np.arange(len(points.ids)), None)], 0
        while todo:
            p, rows, parent = todo.pop()
            node = len(self.centres)
            if parent is not None:
                self.children[parent].append(node)
            x = p.entries * weight[p.terms]
            centre = np.bincount(p.terms, x, len(weight)) / len(rows)
            norms, length = np.add.reduceat(x * x, p.begins[:-1]), float(centre @ centre)
            square = norms - 2 * p.dot(centre, x) + length
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(np.maximum(square, 0) + SLACK * (norms + length)).max()))
            self.peaks.append(np.zeros(len(weight)))
            self.children.append([])
            self.leaves.append(None)
            if len(rows) <= LEAF:
                np.maximum.at(self.peaks[node], p.terms, x)
                self.leaves[node] = (done, done + len(rows))
                parts.append(rows)
                done += len(rows)
                continue
            # away from the farthest point, towards the one that is farthest from it; halves of equal size
            far = np.zeros(len(weight))
            for k in (int(np.argmax(square)), None):
                if k is None:
                    k = int(np.argmax(norms - 2 * p.dot(far, x)))
                    far = -far
                at = slice(p.begins[k], p.begins[k + 1])
                far[p.terms[at]] += x[at]
            order = np.argsort(p.dot(far, x), kind="stable")
            for half in (order[: len(order) // 2], order[len(order) // 2 :]):
                half = np.sort(half)
                todo.append((p.take(half), rows[half], node))
        self.points = points.take(np.concatenate(parts))
        for node in range(len(self.centres) - 1, -1, -1):  # children have higher numbers
            for child in self.children[node]:
                np.maximum(self.peaks[node], self.peaks[child], out=self.peaks[node])
        self.centres, self.peaks = np.array(self.centres).T.copy(), np.array(self.peaks).T.copy()  # a row for each term
        self.radii = np.array(self.radii)

    def bounds(self, terms: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """What no point of each node exceeds."""
        q = repeats.astype(float)
        ball = q @ self.centres[terms] + math.sqrt(float(q @ q)) * self.radii
        return np.minimum(ball, q @ self.peaks[terms]) * (1 + SLACK) + 1


class Best:
    """The best rows of one item so far: highest score first, then the least id, null last."""

    def __init__(self, top: int) -> None:
        self.top, self.least = top, 1
        self.score, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        some = score >= self.least
        if not some.any():
            return
        score, ids, none = np.concatenate([self.score, score[some]]), np.concatenate([self.ids, ids[some]]), np.concatenate([self.none, none[some]])
        order = np.lexsort([ids, none, -score])[: self.top]
        self.score, self.ids, self.none = score[order], ids[order], none[order]
        if len(order) == self.top:
            self.least = int(self.score[-1])  # an equal score with a lower id comes in


def visit(tree: BallTree, terms: np.ndarray, repeats: np.ndarray, wanted: np.ndarray, best: Best) -> int:
    """Best-first search of a tree; wanted is the item's dense vector of integer weights. Returns how many leaves were scored."""
    bounds, points, seen = tree.bounds(terms, repeats), tree.points, 0
    heap = [(-bounds[0], 0)]
    while heap and -heap[0][0] >= best.least:
        node = heapq.heappop(heap)[1]
        if tree.leaves[node] is None:
            for child in tree.children[node]:
                if bounds[child] >= best.least:
                    heapq.heappush(heap, (-bounds[child], child))
            continue
        a, z = tree.leaves[node]
        at = slice(points.begins[a], points.begins[z])
        best.add(np.add.reduceat(points.entries[at] * wanted[points.terms[at]], points.begins[a:z] - points.begins[a]), points.ids[a:z], points.none[a:z])
        seen += 1
    return seen


def saturated(often: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term that a document has so often adds for each unit of its weight."""
    m = 100 - 25 + _times(25 * n, documents) // length
    return (_times(often, 1_000_000_000) // (_times(often, 1000) + 12 * m)).astype(np.int64)


def _searched(items, weight: np.ndarray, documents: int, length: int, top: int):
    """A task's best documents for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        best, exact, used = [Best(top) for _ in block.ids], weight.astype(np.int64), np.zeros(len(weight), np.int64)
        held: list[tuple] = []
        size = 0

        def search() -> None:
            ids, n, terms, often = zip(*held)
            none = np.array([i is None for i in ids])
            of = np.array([len(t) // 4 for t in terms], np.int64)
            flat = np.frombuffer(b"".join(terms), "<u4").astype(np.int64)
            entries = saturated(np.frombuffer(b"".join(often), "<u4").astype(np.int64), np.repeat(np.array(n, np.int64), of), documents, length)
            points = Points(np.array([i or 0 for i in ids], np.int64), none, np.concatenate([[0], np.cumsum(of)]), flat, entries)
            tree = BallTree(points, weight)
            for mine, t, r in zip(best, block.terms, block.repeats):
                used[t] = exact[t] * r
                visit(tree, t, r, used, mine)
                used[t] = 0

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "terms", "often"))):
                if row[2]:
                    held.append(row)
                    size += len(row[2]) // 4
                    if len(held) >= TREE or size >= ENTRIES:
                        search()
                        held, size = [], 0
        if held:
            search()
        for k, (item_id, mine) in enumerate(zip(block.ids, best)):
            m = len(mine.score)
            if m:
                yield pa.RecordBatch.from_arrays([pa.array([k] * m, pa.int64()), pa.array([item_id] * m, pa.int64()), pa.array(mine.ids, mask=mine.none), pa.array(mine.score)], ["item", "item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each item, the documents that score highest, above 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    t, out = Tables(spark), None
    for k, block in enumerate(item_blocks(items)):
        held = spark.sparkContext.broadcast(block)
        points = t.write(f"points_{k}", docs.mapInArrow(_points(held), "doc_id long, n long, terms binary, often binary"))
        documents, length = points.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = np.zeros(len(block.vocabulary), np.int64)
        for r in points.select("terms").mapInArrow(_frequencies(len(df)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the block's terms
            df[r["term"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], float)
        found = points.mapInArrow(_searched(held, weight, documents, length or 1, top), "item long, item_id long, doc_id long, score long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = t.write(f"best_{k}", found.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))
        t.drop(f"points_{k}")
        held.destroy()
        out = best if out is None else out.union(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
ORACLE_SQL = {
    "op12_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS k, item_id, {_TERMS} AS w FROM benchmark),
it AS (SELECT k, item_id, term, count(*) AS c FROM (SELECT k, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN it USING (term) GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS wt FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), s),
x AS (SELECT tf.r, doc_id, term, wt * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * docs) // total))) AS x FROM tf JOIN d USING (r) JOIN wt USING (term), s),
sc AS (SELECT k, item_id, r, doc_id, sum(c * x)::BIGINT AS score FROM it JOIN x USING (term) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20"""
}
QUERIES = {"op12_ranked_search": op12_ranked_search}
