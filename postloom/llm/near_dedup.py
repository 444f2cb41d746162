"""Near-duplicate groups by a chosen-path set-similarity join over minwise tokens.

Documents with equal shingle sets are one class. Each tree of the join starts by branching the classes by one minwise token;
a node of at most LEAF classes is compared exhaustively, a larger one is branched again, by the next of the tree's own tokens.
A node that is still large after LEVELS of them is compared exhaustively too, by blocks. So a pair is compared if it shares
the tokens of LEVELS levels in any tree; trees share no token, and their number follows from RECALL, the odds that a
pair at the threshold is compared.

Comparison has two steps. Sketches tell which classes of a node are likely to be similar; each link is then confirmed on the
full sets, of which every class has one, made once. Where all that hangs together by likely pairs is at most BLOCK classes,
these are compared with each other once, whatever the number of trees that found them. In larger, dense groups the nodes
of a few trees and the blocks around a central class come first; what these join to one component is not compared again.

Hot groups: exact copies are one class, found by map-side combination. A large node's classes meet its central class in
blocks, and meet each other only as far as they are of different components. Joins with a hot key have a written table on
each side, so that Spark splits them.

Defined results: documents without words (null, empty, blank) have no shingles, are linked with nothing and are kept.
Each row stands for itself: rows with one id and different texts are linked by their texts; rows with equal id and text are
copies of each other. Rows without an id are linked too; the least id of a component leaves them out, so it is null only
where no row has an id, and of such a component the row with the least key is kept. Other columns are not read. Sets, words
and rows are told apart by 64-bit hashes. docs must give the same rows when it is read again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import Tables, mix, table, word_hashes

WORDS = 5
THRESHOLD = 80  # per cent
COORDINATES = 64
LEAF = 32
LEVELS = 3
RECALL = 0.9998
#: The least number of independent trees of which one keeps a pair at the threshold together, with odds of RECALL.
TREES = math.ceil(math.log(1 - RECALL) / math.log(1 - (THRESHOLD / 100) ** LEVELS))
#: Trees whose nodes are compared first in dense groups.
FIRST = 3
#: Classes that are compared at once.
BLOCK = 128
#: Agreeing coordinates, of COORDINATES, from which a pair is compared in full: four standard deviations below the threshold.
LIKELY = int(COORDINATES * THRESHOLD / 100 - 4 * (COORDINATES * THRESHOLD / 100 * (1 - THRESHOLD / 100)) ** 0.5)
_U = np.uint64
_A = mix(np.arange(1, COORDINATES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_B = mix(np.arange(1, COORDINATES + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
assert TREES * LEVELS <= COORDINATES and TREES <= 256


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text, as sorted hashes of its shingles; fewer words are one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, _U)
    for k in range(n):
        h = mix(h * _U(3) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def class_of(s: np.ndarray) -> int:
    """A set's class: equal sets have equal numbers."""
    sums = np.array([mix(s).sum(dtype=_U), mix(s ^ _A[0]).sum(dtype=_U)], _U)
    return int(mix(mix(sums[:1]) * _U(3) + sums[1:] + _U(len(s))).astype(np.int64)[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate."""
    out = np.full(COORDINATES, ~_U(0), _U)
    for k in range(0, len(s), 4096):
        np.minimum(out, (s[None, k : k + 4096] * _A[:, None] + _B[:, None]).min(1), out=out)
    return (out >> _U(32)).astype("<u4")


def _sketches(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u4").reshape(-1, COORDINATES)


def row_key() -> Column:
    """A row's key: rows with equal id and text share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, of, sketches = [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                of.append(class_of(s) if len(s) else None)
                sketches.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of, pa.int64()), pa.array(sketches, pa.binary())], ["key", "doc_id", "n", "cls", "sketch"])

    return run


def _sets(words: int):
    """The sets of classes, from the texts of their first rows; a row of another class that shares a key is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {}
            for cls, text in zip(b.column("cls").to_pylist(), b.column("text")):
                if cls not in out and class_of(s := shingles(text.as_py(), words)) == cls:
                    out[cls] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array(out.values(), pa.binary())], ["cls", "tokens"])

    return run


def _of_tree(hashes: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """Node numbers: a node has its tree in the last eight bits."""
    return (hashes & ~_U(255)) | trees


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sk = _sketches(b["sketch"]).astype(_U) if len(b) else np.zeros((0, COORDINATES), _U)
        trees = np.arange(TREES, dtype=_U)
        nodes = _of_tree(mix(mix(sk[:, :TREES] + (trees << _U(32))[None, :]) ^ _B[0]), trees[None, :])
        own = sk[:, : TREES * LEVELS].reshape(-1, LEVELS, TREES).transpose(0, 2, 1)[:, :, 1:]  # of each tree, its tokens for the levels to come
        yield pd.DataFrame({"node": nodes.astype(np.int64).ravel(), "cls": np.repeat(b["cls"].to_numpy(np.int64), TREES), "own": [x.tobytes() for x in own.reshape(-1, LEVELS - 1).astype("<u4")]})


def _children(level: int):
    """Branch each (node, class, own) by the token of its tree's own coordinate for the level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            node = b["node"].to_numpy(np.int64).astype(_U)
            token, tree = np.frombuffer(b"".join(b["own"]), "<u4").reshape(-1, LEVELS - 1)[:, level - 1].astype(_U), node & _U(255)
            at = tree + _U(level * TREES)
            child = _of_tree(mix(mix(node) ^ mix(token + (at << _U(32)))), tree)
            yield pd.DataFrame({"node": child.astype(np.int64), "cls": b["cls"], "own": b["own"]})

    return run


def by_unit(df: DataFrame, f: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """f on the rows of whole units, in order of units, with the places where units begin and the end. Units are bounded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for b in batches:
            unit = b["unit"].to_numpy(np.int64)
            if not len(unit):
                continue
            cuts = np.flatnonzero(unit[1:] != unit[:-1]) + 1
            if held and unit[0] != last:
                yield whole(held)
                held = []
            if len(cuts):
                yield whole([*held, b.iloc[: cuts[-1]]])
                held = [b.iloc[cuts[-1] :]]
            else:
                held.append(b)
            last = unit[-1]
        if held:
            yield whole(held)

    def whole(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        unit = rows["unit"].to_numpy(np.int64)
        return f(rows, np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]]))

    return df.repartition("unit").sortWithinPartitions("unit").mapInPandas(run, schema)


def _root(group: np.ndarray, k: int) -> int:
    while group[k] != k:
        k = group[k]
    return k


def _likely(rows: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
    """What hangs together, within a unit, by likely pairs of different components: a row for each class of such a cluster."""
    cls, c, tree = (rows[x].to_numpy(np.int64) for x in ("cls", "c", "tree"))
    sk = _sketches(rows["sketch"]).astype("<u2")
    out: list[np.ndarray] = []
    for a, z in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if z - a < 2:
            continue
        if z - a == 2:
            near = c[a] != c[a + 1] and (sk[a] == sk[a + 1]).sum() >= LIKELY
            parts = [np.array([a, a + 1])] if near else []
        else:
            s, of = sk[a:z], c[a:z]
            alike = np.zeros((z - a, z - a), np.uint8)
            for k in range(COORDINATES):
                alike += s[:, k, None] == s[None, :, k]
            x, y = np.nonzero(np.triu((alike >= LIKELY) & (of[:, None] != of[None, :]), 1))
            group = np.arange(z - a)
            for i, j in zip(x.tolist(), y.tolist()):
                i, j = _root(group, i), _root(group, j)
                group[max(i, j)] = min(i, j)
            roots = np.array([_root(group, k) for k in range(z - a)])
            parts = [a + np.flatnonzero(roots == r) for r in np.flatnonzero(np.bincount(roots, minlength=z - a) > 1)]
        for at in parts:
            of_cluster = cls[at]
            cluster = mix(mix(of_cluster.astype(_U)).sum(dtype=_U).reshape(1)).astype(np.int64)[0]
            out.append(np.stack([np.full(len(at), cluster), np.full(len(at), of_cluster.min()), of_cluster, tree[at]], 1))
    return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 4), np.int64), columns=["unit", "head", "cls", "tree"])


def _links(threshold: int):
    """Of each unit, links that join all components that its similar pairs join."""

    def run(rows: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        c, blobs, out = rows["c"].to_numpy(np.int64), rows["tokens"].tolist(), []
        for a, z in zip(begins[:-1].tolist(), begins[1:].tolist()):
            sets = [np.frombuffer(x, _U) for x in blobs[a:z]]
            size = np.array([len(s) for s in sets], np.int64)
            if z - a == 2:
                both = len(np.intersect1d(*sets, assume_unique=True)) if size.min() * 100 >= threshold * size.max() else 0
                if c[a] != c[a + 1] and 100 * both >= threshold * (size.sum() - both):
                    out.append((c[a], c[a + 1]))
                continue
            tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
            at = np.concatenate([[0], np.cumsum(size)])
            group, held = c[a:z].copy(), np.zeros(len(tokens), np.int64)
            for i in range(z - a - 1):
                rest = group[i + 1 :] != group[i]
                if not rest.any():
                    continue
                mine = code[at[i] : at[i + 1]]
                held[mine] = 1
                both = np.add.reduceat(held[code[at[i + 1] :]], at[i + 1 : -1] - at[i + 1])
                held[mine] = 0
                for j in (i + 1 + np.flatnonzero(rest & (100 * both >= threshold * (size[i] + size[i + 1 :] - both)))).tolist():
                    if group[i] != group[j]:
                        out.append((c[a + i], c[a + j]))
                        group[group == group[j]] = group[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def in_blocks(t: Tables, large: DataFrame, half: int = BLOCK // 2) -> DataFrame:
    """large (node, cls, c) as units of two blocks of `half` each: all pairs of different components of a node are in one.

    The classes of a node's largest component have no pairs to look for among them, so they meet only the others.
    """
    counts = large.groupBy("node", "c").agg(F.count(F.lit(1)).alias("n"))
    nodes = counts.groupBy("node").agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    blocks = lambda n: F.ceil(n / half).cast("int")
    nodes = t.write("block_counts", nodes.select("node", F.col("most.c").alias("main"), blocks(F.col("most.n")).alias("k_main"), blocks(F.col("n") - F.col("most.n")).alias("k_rest")))
    rows = large.join(nodes, "node").withColumn("is_main", F.col("c") == F.col("main"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("cls"), F.when(F.col("is_main"), F.col("k_main")).otherwise(F.col("k_rest"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda kind, i, j: F.xxhash64(F.col("node"), F.lit(kind), i, j)
    main = F.transform(upto(F.col("k_rest")), lambda i: cell("main", i, F.col("at")))
    rest = F.concat(
        F.transform(upto(F.col("k_main")), lambda j: cell("main", F.col("at"), j)),
        F.transform(upto(F.col("k_rest")), lambda j: cell("rest", F.least("at", j), F.greatest("at", j))),
    )
    return rows.select(F.explode(F.when(F.col("is_main"), main).otherwise(rest)).alias("unit"), "cls", "c")


def components(t: Tables, edges: DataFrame, name: str) -> DataFrame:
    """A table of v and c: the least vertex that can be reached from v. Labels fall along edges and jump to their label's label."""
    both = t.write(f"{name}_edges", edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u <> v").distinct())
    labels = t.write(f"{name}_0", both.groupBy("v").agg(F.min("u").alias("c")).select("v", F.col("v").alias("old"), F.least("c", "v").alias("c")))
    step = 0
    while not labels.where("old <> c").isEmpty():
        now = labels.select("v", "c")
        least = both.join(now, "v").groupBy(F.col("u").alias("v")).agg(F.min("c").alias("m"))
        lower = t.write(f"{name}_lower_{step}", now.join(least, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        labels = t.write(f"{name}_{step + 1}", lower.join(lower.select(F.col("v").alias("c"), F.col("c").alias("root")), "c").select("v", "old", F.col("root").alias("c")))
        t.drop(f"{name}_lower_{step}", f"{name}_{step}")
        step += 1
    return labels.select("v", "c")


def labelled(df: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """df with the component of its column key; what has no link is its own."""
    return df.join(labels.select(F.col("v").alias(key), F.col("c").alias("__c")), key, "left").withColumn(name, F.coalesce("__c", key)).drop("__c")


def around_leaders(t: Tables, large: DataFrame) -> DataFrame:
    """The classes of large nodes in blocks, each with the node's most central class, the one that shares most nodes."""
    central = large.groupBy("cls").agg(F.sum("n").alias("shared"))
    leaders = large.join(central, "cls").groupBy("node").agg(F.max(F.struct("shared", (-F.col("cls")).alias("less"))).alias("l"))
    leaders = t.write("leaders", leaders.select("node", (-F.col("l.less")).alias("leader")))
    led = t.write("led", large.join(leaders, "node").where("cls <> leader").select("cls", "leader").distinct())
    counts = t.write("led_counts", led.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / (BLOCK - 1)).alias("k")))
    rows = led.join(counts, "leader").select("cls", "leader", F.xxhash64("leader", F.pmod(F.xxhash64("cls"), "k")).alias("unit"))
    return rows.select("unit", "cls").union(rows.select("unit", "leader").distinct())


def groups(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that can be reached by links, its own included), kept, row_key, first.

    first: the row is its component's first by id (null last) and key; rows that share id and text are first together.
    """
    t = Tables(docs.sparkSession)
    docs = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = t.write("rows", docs.mapInArrow(_rows(words), "key long, doc_id long, n long, cls long, sketch binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = rows.where("n > 0").groupBy("cls").agg(first.alias("first"), F.any_value("sketch").alias("sketch"))
    classes = t.write("classes", classes.select("cls", "first.key", "first.doc_id", "sketch"))
    sketches = classes.select("cls", "sketch")

    # the trees: small nodes, and those that are large after all levels; nodes carry what they are branched by, so no level meets the sketches again
    small, large, roots = [], None, None
    for level in range(LEVELS):
        if level == 0:
            nodes = sketches.mapInPandas(_roots, "node long, cls long, own binary")
        elif large.isEmpty():
            break
        else:
            nodes = t.write(f"children_{level}", large.select("node", "cls", "own").mapInPandas(_children(level), "node long, cls long, own binary"))
        sizes = t.write(f"sizes_{level}", nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        nodes = t.write(f"nodes_{level}", nodes.join(sizes, "node"))
        small.append(nodes.where(F.col("n") <= LEAF))
        large = nodes.where(F.col("n") > LEAF)
        roots = roots or large
    leaves = small[0]
    for x in small[1:]:
        leaves = leaves.union(x)

    # likely pairs: the same few classes meet in most trees, and each set of classes is looked at once
    leaves = leaves.groupBy("node").agg(F.sort_array(F.collect_set("cls")).alias("of")).groupBy("of").agg(F.min(F.col("node").bitwiseAND(255)).alias("tree"))
    units = leaves.select(F.xxhash64("of").alias("unit"), F.explode("of").alias("cls"), "tree")
    units = units.union(around_leaders(t, roots).select("unit", "cls", F.lit(0).cast("long")))
    likely = by_unit(units.join(sketches, "cls").withColumn("c", F.col("cls")), _likely, "unit long, head long, cls long, tree long")
    likely = t.write("likely", likely.groupBy("unit", "head", "cls").agg(F.min("tree").alias("tree")))
    t.drop("leaders", "led", "led_counts", *[f"sizes_{k}" for k in range(len(small))], *[f"children_{k}" for k in range(1, len(small))])
    together = components(t, likely.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b")), "together")
    dense = t.write("dense", together.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("c"))
    whole = together.join(dense, "c", "left_anti").select(F.col("c").alias("unit"), F.col("v").alias("cls"))
    dense = t.write("dense_classes", together.join(dense, "c", "left_semi").select(F.col("v").alias("cls")))
    parts = t.write("parts", likely.join(dense, "cls", "left_semi").select("unit", "cls", "tree"))

    # the full set of each class that is compared
    needed = together.select(F.col("v").alias("cls")).union(large.select("cls")).distinct()
    needed = t.write("needed", needed.join(classes.select("cls", "key"), "cls"))
    sets_name, sets = "sets", t.write("sets", docs.select("key", "text").join(needed.hint("merge"), "key").mapInArrow(_sets(words), "cls long, tokens binary"))
    made, distinct = sets.agg(F.count("cls"), F.count_distinct("cls")).first()
    if distinct != needed.count():
        raise RuntimeError("the documents are not those that were read before: read docs from a table or a checkpoint")
    t.drop("needed")
    if made > distinct:  # rows with equal id and text
        sets_name, sets = "sets_once", t.write("sets_once", sets.dropDuplicates(["cls"]))
        t.drop("sets")

    # links: all of what hangs together in small groups, the first trees of dense ones; then what is still apart
    confirmed = lambda rows: by_unit(rows.select("unit", "cls", "c").join(sets, "cls"), _links(threshold), "a long, b long")
    begin = whole.union(parts.where(F.col("tree") < FIRST).select("unit", "cls")).withColumn("c", F.col("cls"))
    joined = components(t, t.write("links", confirmed(begin)), "joined")
    apart = labelled(parts.where(F.col("tree") >= FIRST), joined, "cls", "c")
    open_ = t.write("open", apart.groupBy("unit").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("unit"))
    apart = apart.join(open_, "unit").select("unit", "cls", "c")
    if not large.isEmpty():
        cells = in_blocks(t, t.write("labelled", labelled(large.select("node", "cls"), joined, "cls", "c"))).distinct()
        cells = by_unit(cells.join(sketches, "cls").withColumn("tree", F.lit(0).cast("long")), _likely, "unit long, head long, cls long, tree long")
        apart = apart.union(labelled(cells.select("unit", "cls").distinct(), joined, "cls", "c").select("unit", "cls", "c"))
    last = components(t, t.write("last_links", confirmed(apart)), "last")
    t.drop("parts", "likely", sets_name, *[f"nodes_{k}" for k in range(len(small))])

    linked = labelled(labelled(classes.select("cls", "key", "doc_id"), joined, "cls", "c1"), last, "c1", "c")
    firsts = t.write("firsts", linked.groupBy("c").agg(first.alias("first")).select("c", F.col("first.key").alias("first_key"), F.col("first.doc_id").alias("first_id")))
    final = t.write("final", linked.select("cls", "c").join(firsts, "c").select("cls", "first_key", "first_id"))
    rows = rows.select("key", "doc_id", "n", "cls")
    alone = rows.where("n = 0").select("key", "doc_id", "n", F.col("key").alias("first_key"), F.col("doc_id").alias("first_id"))
    out = rows.where("n > 0").join(final, "cls").select("key", "doc_id", "n", "first_key", "first_id").union(alone)
    is_first = (F.col("key") == F.col("first_key")).alias("first")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("first_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("first_id"), is_first).alias("kept"), F.col("key").alias("row_key"), is_first)


def deduplicate(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row of each group: the first by id (null last). Rows are told apart by id and text, so that a row which
    shares its id with a copy stays, and of rows that share both one stays. Rows without words stay, all of them.
    """
    t = Tables(docs.sparkSession)
    found = groups(docs, words, threshold).where("n_shingles > 0").groupBy(F.col("row_key").alias("__key")).agg(F.bool_or("first").alias("__first"), F.count(F.lit(1)).alias("__n"))
    told = t.write("told", found.where("not __first or __n > 1").select("__key", "__first"))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), row_key().alias("__key")).join(told, "__key", "left")  # the columns' names stay among themselves
    kept = rows.where("__first is null").select("__row").union(rows.where("__first").dropDuplicates(["__key"]).select("__row"))
    return kept.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


_SHINGLES = """
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1)"""
ORACLE_SQL = {
    "op9_near_dedup": f"""
WITH RECURSIVE {_SHINGLES},
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
c AS (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""
}
QUERIES = {"op9_near_dedup": op9_near_dedup}
