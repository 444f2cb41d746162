"""N-gram Jaccard join by token-combination prefixes.

Documents with equal shingle sets are one class. A token is a shingle's hash; tokens are in one order for all documents: those
of no frequent class first, by hash, then frequent ones, rarer classes first. Two sets at the threshold share a token among
the first n - ceil(t n) + 1 of each, and two tokens among one more. Sets of at most SHORT tokens index what the longer prefix
has: each rare token by itself, and frequent ones by pairs, so that a line or passage of very many documents brings only those
together which share two of its tokens early. Pairs grow with the square of a prefix, so longer sets index single tokens;
sets short enough to meet them do both. No pair at the threshold is lost by this, whatever tokens count as frequent.

Frequent tokens are the FREQUENT most frequent of all documents' prefixes by hash; how many are told apart changes the work only.

Verification is exact too. Classes of a small node (those that share an index key) are compared by bitmaps of their tokens: bits
that only one of two sets has are tokens that only it has, so that a pair with too many of them is no link. What hangs together
by pairs that are left is compared on full sets, which are made once: all at once where it is at most BLOCK classes; in larger,
dense groups the blocks around each node's central class come first, and what these join is not compared again. Large nodes
of one central class are one node from then on, so that two classes meet there once, however many keys they share; it is compared
by blocks as far as its classes are still of different components.

Defined results: documents without words (null, empty, blank) have no shingles and are linked with nothing. Each row stands for
itself: rows with one id and different texts are linked by their texts. Rows without an id are linked too; the least id of a
component leaves them out, so it is null only where no row has an id. Other columns are not read. Shingles, sets and rows are
told apart by 64-bit hashes. docs must give the same rows when it is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import Tables, mix, table
from postloom.llm.near_dedup import BLOCK, LEAF, _root, _sets, by_unit, class_of, components, in_blocks, labelled, row_key, shingles
from postloom.llm.near_dedup import _links as links_of
from postloom.llm.near_dedup import _SHINGLES

WORDS = 5
THRESHOLD = 80  # per cent
#: Sets of at most so many tokens index pairs of frequent tokens.
SHORT = 200
#: Tokens that are told apart by how frequent they are, at most, and documents' prefixes that a token needs for it, at least.
FREQUENT, LEAST = 500_000, 8
#: Classes of a large node that are compared at once, by their bitmaps.
LARGE = 512
#: Bits of a set's bitmap: the power of two from four for each token on, within these bounds.
LEAST_BITS, MOST_BITS = 512, 1 << 17
_U = np.uint64


def overlap(n: int, threshold: int) -> int:
    """The tokens that a set of n shares at least with any set at the threshold."""
    return -(-n * threshold // 100)


def bitmap(s: np.ndarray) -> bytes:
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(s) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(mix(s) & _U(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _folded(blobs: list[bytes], size: int) -> np.ndarray:
    """Bitmaps, as rows of 64-bit numbers, as if they had been made with so many bytes."""
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, "<u8").reshape(-1, size // 8)) for b in blobs])


def _rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, of, bits = [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                of.append(class_of(s) if len(s) else None)
                bits.append(bitmap(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of, pa.int64()), pa.array(bits, pa.binary())], ["key", "doc_id", "n", "cls", "bits"])

    return run


def _first_tokens(words: int, threshold: int):
    """The prefixes by hash alone: a sample of tokens in which frequent ones are as frequent as in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text"):
                s = shingles(text.as_py(), words)
                out.append(s[: len(s) - overlap(len(s), threshold) + 1] if len(s) else s)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*out, np.zeros(0, _U)]).astype(np.int64))], ["token"])

    return run


def frequent_tokens(docs: DataFrame, words: int, threshold: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, with their classes (from 1, four to a doubling): as many whole classes as `most` holds."""
    counts = docs.select("text").mapInArrow(_first_tokens(words, threshold), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    t = Tables(docs.sparkSession)
    classed = t.write("frequent", counts.select("token", (F.floor(4 * F.log2(F.col("n") / LEAST)) + 1).cast("int").alias("class")))
    room, least = most, 1 << 30
    for r in sorted(classed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["class"]):  # four rows a doubling
        room -= r["n"]
        if room < 0:
            break
        least = r["class"]
    got = classed.where(F.col("class") >= least).toArrow()
    t.drop("frequent")
    tokens, classes = got.column("token").to_numpy().astype(np.int64).view(_U), got.column("class").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], classes[order]


def keys_of(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], threshold: int, short: int = SHORT) -> np.ndarray:
    """A set's index keys: its prefix's tokens one by one, or rare ones so and frequent ones by pairs, or both."""
    tokens, classes = frequent
    n = len(s)
    share = overlap(n, threshold)
    if not n:
        return s
    at = np.minimum(np.searchsorted(tokens, s), max(0, len(tokens) - 1))
    class_ = np.where(tokens[at] == s, classes[at], 0) if len(tokens) else np.zeros(n, np.int64)
    order = np.argsort(class_, kind="stable")  # s is sorted by hash
    out = []
    if n <= short:
        first = order[: n - share + 2]
        rare = s[first[class_[first] == 0]]
        often = s[first[class_[first] > 0]]
        i, j = np.triu_indices(len(often), 1)
        out += [rare, mix(mix(often[i]) * _U(3) + mix(often[j] ^ _U(0x9E3779B97F4A7C15)))]
        # a set may be near one that is longer than `short`, or share no more than one token with a near one
        if share > 1 and overlap(short + 1, threshold) > n:
            return np.concatenate(out)
    out.append(s[order[: n - share + 1]])
    return np.unique(np.concatenate(out))


def _index(words: int, threshold: int, frequent, short: int):
    """Keys of each class, once in a task however many copies of a text it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            nodes, of, size = [np.zeros(0, _U)], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), words)
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                seen.add(c)
                nodes.append(keys_of(s, frequent.value, threshold, short))
                of.append(c), size.append(len(nodes[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).astype(np.int64)), pa.array(np.repeat(np.array(of, np.int64), size))], ["node", "cls"])

    return run


def _possible(threshold: int):
    """What hangs together, within a unit, by pairs of different components that bitmaps and sizes do not rule out."""

    def pairs(n: np.ndarray, c: np.ndarray, blobs: list[bytes]) -> Iterator[tuple[int, int]]:
        size = np.array([len(b) for b in blobs])
        for width in np.unique(size).tolist():  # sets at the threshold have bitmaps of one width, or of one and its double
            at = np.concatenate([np.flatnonzero(size == width), np.flatnonzero(size == 2 * width)])
            bits = _folded([blobs[k] for k in at], width)
            ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
            for i in range(int((size == width).sum())):
                n_i, n_j = n[at[i]], n[at[i + 1 :]]
                some = np.flatnonzero((c[at[i + 1 :]] != c[at[i]]) & (100 * np.minimum(n_i, n_j) >= threshold * np.maximum(n_i, n_j)))
                j = i + 1 + some
                both = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)
                most = np.minimum(n_i - (ones[i] - both), n[at[j]] - (ones[j] - both))  # of what they share
                for k in j[100 * most >= threshold * (n_i + n[at[j]] - most)].tolist():
                    yield int(at[i]), int(at[k])

    def run(rows: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        cls, c, n = (rows[x].to_numpy(np.int64) for x in ("cls", "c", "n"))
        blobs, step, out, parts = rows["bits"].tolist(), rows["step"].to_numpy(np.int64), [], []
        for a, z in zip(begins[:-1].tolist(), begins[1:].tolist()):
            group = np.arange(z - a)
            for x, y in pairs(n[a:z], c[a:z], blobs[a:z]) if z - a > 1 else ():
                x, y = _root(group, x), _root(group, y)
                group[max(x, y)] = min(x, y)
            roots = np.array([_root(group, k) for k in range(z - a)])
            parts += [a + np.flatnonzero(roots == r) for r in np.flatnonzero(np.bincount(roots, minlength=z - a) > 1)]
        for at in parts:
            mine = cls[at]
            unit = mix(mix(mine.astype(_U)).sum(dtype=_U).reshape(1)).astype(np.int64)[0]
            out.append(np.stack([np.full(len(at), unit), np.full(len(at), mine.min()), mine, step[at]], 1))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 4), np.int64), columns=["unit", "head", "cls", "step"])

    return run


def around_central(t: Tables, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of large nodes (node, cls, n) with their nodes' central class, the one that shares most; and blocks of both."""
    central = large.groupBy("cls").agg(F.sum("n").alias("shared"))
    leaders = large.join(central, "cls").groupBy("node").agg(F.max_by("cls", F.struct("shared", "cls")).alias("leader"))
    led = t.write("led", large.join(t.write("leaders", leaders), "node").select("cls", "leader").distinct())
    counts = t.write("led_counts", led.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / (BLOCK - 1)).alias("k")))
    rows = led.where("cls <> leader").join(counts, "leader").select("cls", "leader", F.xxhash64("leader", F.pmod(F.xxhash64("cls"), "k")).alias("unit"))
    return led, rows.select("unit", "cls").union(rows.select("unit", "leader").distinct())


def join(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, short: int = SHORT, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the least id that can be reached by links, its own included."""
    spark = docs.sparkSession
    t = Tables(spark)
    docs = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = t.write("rows", docs.mapInArrow(_rows(words), "key long, doc_id long, n long, cls long, bits binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = rows.where("n > 0").groupBy("cls").agg(first.alias("first"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"))
    classes = t.write("classes", classes.select("cls", "first.key", "first.doc_id", "n", "bits"))
    bits = classes.select("cls", "n", "bits")

    # index keys that classes share
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs, words, threshold, most))
    index = t.write("index", docs.select("text").mapInArrow(_index(words, threshold, frequent, short), "node long, cls long"))
    shared = t.write("shared", index.groupBy("node").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("node"))
    nodes = t.write("members", index.join(shared, "node").distinct())
    t.drop("index", "shared")
    frequent.destroy()
    sizes = t.write("sizes", nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    nodes = t.write("nodes", nodes.join(sizes, "node"))
    t.drop("members", "sizes")
    small, large = nodes.where(F.col("n") <= LEAF), nodes.where(F.col("n") > LEAF)

    # pairs that may be links: each set of classes is looked at once, however many keys it shares
    sets_of = small.groupBy("node").agg(F.sort_array(F.collect_set("cls")).alias("of")).select("of").distinct()
    units = sets_of.select(F.xxhash64("of").alias("unit"), F.explode("of").alias("cls"), F.lit(1).cast("long").alias("step"))
    led, central = around_central(t, large)
    units = units.union(central.select("unit", "cls", F.lit(0).cast("long")))
    schema = "unit long, head long, cls long, step long"
    possible = by_unit(units.join(bits, "cls").withColumn("c", F.col("cls")), _possible(threshold), schema)
    possible = t.write("possible", possible.groupBy("unit", "head", "cls").agg(F.min("step").alias("step")))
    t.drop("leaders", "led_counts")
    together = components(t, possible.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b")), "together")
    dense = t.write("dense", together.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("c"))
    whole = together.join(dense, "c", "left_anti").select(F.col("c").alias("unit"), F.col("v").alias("cls"))
    dense = t.write("dense_classes", together.join(dense, "c", "left_semi").select(F.col("v").alias("cls")))
    parts = t.write("parts", possible.join(dense, "cls", "left_semi").select("unit", "cls", "step"))
    t.drop("possible")

    # the full set of each class that is compared
    needed = together.select(F.col("v").alias("cls")).union(led.select("cls")).distinct()
    needed = t.write("needed", needed.join(classes.select("cls", "key"), "cls"))
    sets = t.write("sets", docs.select("key", "text").join(needed.hint("merge"), "key").mapInArrow(_sets(words), "cls long, tokens binary"))
    if sets.select("cls").distinct().count() != needed.count():
        raise RuntimeError("the documents are not those that were read before: read docs from a table or a checkpoint")
    sets_once = t.write("sets_once", sets.dropDuplicates(["cls"]))
    t.drop("needed", "sets")

    # links: all of what hangs together in small groups, and blocks of dense ones; then what is still apart
    confirmed = lambda rows: by_unit(rows.select("unit", "cls", "c").join(sets_once, "cls"), links_of(threshold), "a long, b long")
    begin = whole.union(parts.where("step = 0").select("unit", "cls")).withColumn("c", F.col("cls"))
    joined = components(t, t.write("links", confirmed(begin)), "joined")
    apart = labelled(parts.where("step = 1"), joined, "cls", "c")
    open_ = t.write("open", apart.groupBy("unit").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("unit"))
    apart = apart.join(open_, "unit").select("unit", "cls", "c")
    if not led.isEmpty():
        cells = in_blocks(t, t.write("labelled", labelled(led.select(F.col("leader").alias("node"), "cls"), joined, "cls", "c")), LARGE // 2)
        cells = by_unit(cells.join(bits, "cls").withColumn("step", F.lit(0).cast("long")), _possible(threshold), schema)
        apart = apart.union(labelled(cells.select("unit", "cls").distinct(), joined, "cls", "c").select("unit", "cls", "c"))
    last = components(t, t.write("last_links", confirmed(apart)), "last")
    t.drop("parts", "nodes", "led", "sets_once", "dense", "dense_classes", "links", "open")

    of = labelled(labelled(classes.select("cls", "doc_id"), joined, "cls", "c1"), last, "c1", "c")
    least = t.write("least", of.groupBy("c").agg(F.min("doc_id").alias("component_id")))
    final = t.write("final", of.select("cls", "c").join(least, "c").select("cls", "component_id"))
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = rows.where("n > 0").select("doc_id", "n", "cls").join(final, "cls").select("doc_id", "n", "component_id").union(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), words=4, threshold=85)


ORACLE_SQL = {
    "op11_ngram_join": f"""
WITH RECURSIVE {_SHINGLES},
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
c AS (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)"""
}
QUERIES = {"op11_ngram_join": op11_ngram_join}
