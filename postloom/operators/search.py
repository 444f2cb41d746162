"""Substring search by a table of trigrams.

Every row of a searched frame has a posting for each of its distinct trigrams. Rows that lie together share a list for each
trigram; lists are in folders by a hash of the trigram, sorted, so that a query reads those of its own trigrams and the rows that
have all of them, and is then looked for in those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.operators.filters import searched_text, wanted_of
from postloom.shared import checkpointed, remove

N = 3
#: Characters of the texts that share lists; what a task holds at once follows it.
CHARS = 1 << 20
#: Rows that may hold a query, of which every task may have the keys.
SENT = 2_000_000


def _lists(keys: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """The distinct trigrams of some texts, each with the keys of the texts that have it."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    if len(points) < N:
        return
    letters = np.flatnonzero(np.bincount(points))
    a, n = len(letters), len(texts)
    if a**N * n >= 1 << 63:  # more kinds of letters than a long has room for; one text always fits
        for lo, hi in ((0, n // 2), (n // 2, n)):
            yield from _lists(keys[lo:hi], texts[lo:hi])
        return
    rank = np.zeros(int(letters[-1]) + 1, dtype=np.int64)
    rank[letters] = np.arange(a)
    c, of = rank[points], np.repeat(np.arange(n), [len(t) for t in texts])
    gram = (c[:-2] * a + c[1:-1]) * a + c[2:]
    gram, of = np.divmod(np.unique((gram * n + of[:-2])[of[:-2] == of[2:]]), n)
    if not len(gram):
        return
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    own = gram[first]
    spelled = letters[np.stack([own // (a * a), own // a % a, own % a], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    held = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)), pa.int32()), keys.take(pa.array(of)))
    yield pa.RecordBatch.from_arrays([pa.array([spelled[k : k + N] for k in range(0, len(spelled), N)]), held], ["gram", "keys"])


def _listed(chars: int = CHARS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            cuts = [0, *(np.flatnonzero(np.diff(ends // chars)) + 1).tolist(), len(texts)]
            for lo, hi in zip(cuts, cuts[1:]):
                yield from _lists(batch.column(0)[lo:hi], texts[lo:hi])

    return run


class TrigramTable:
    """Postings of a frame's rows in a folder. rows: a column id, each once, and the columns that are searched."""

    def __init__(self, rows: DataFrame, key: str, columns: list[str], path: str, buckets: int = 64) -> None:
        self.rows, self.key, self.columns, self.path, self.buckets = rows, key, columns, path, buckets

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def write(self) -> TrigramTable:
        """Makes the lists anew. A trigram of most rows has as many, in as many files as it needs."""
        text = searched_text(self.rows, self.columns)
        texts = self.rows.select(self.key, text.cast("binary").alias("__text")).where(F.length(text) >= N)
        lists = texts.mapInArrow(_listed(), T.StructType([T.StructField("gram", T.StringType()), T.StructField("keys", T.ArrayType(self.rows.schema[self.key].dataType))]))
        bucketed = lists.withColumn("bucket", self._bucket(F.col("gram"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(self.path)
        return self

    def postings(self, query: str) -> DataFrame:
        """The lists of a query's trigrams (gram, keys): no other folders are read."""
        wanted = wanted_of(query)
        grams = sorted({wanted[k : k + N] for k in range(len(wanted) - N + 1)})
        spark = self.rows.sparkSession
        buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(self._bucket(F.col("gram"))).distinct().collect()]
        return spark.read.parquet(self.path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).select("gram", "keys")

    def candidates(self, query: str) -> DataFrame:
        """Keys of the rows that have all trigrams of a query."""
        wanted = wanted_of(query)
        n = len({wanted[k : k + N] for k in range(len(wanted) - N + 1)})
        return self.postings(query).select(F.explode("keys").alias(self.key)).groupBy(self.key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == n).select(self.key)

    def search(self, query: str) -> DataFrame:
        """The rows that hold the query in any case. One of fewer than three characters is looked for in every row.

        Up to SENT candidates are sent to the rows, so that no text is shuffled; of more, texts are, and none is sorted.
        """
        wanted = wanted_of(query)
        some = self.rows
        if len(wanted) >= N:
            found = checkpointed(self.candidates(query))
            some = some.join(F.broadcast(found) if found.count() <= SENT else found.hint("shuffle_hash"), self.key, "left_semi")
        return some.where(F.contains(searched_text(self.rows, self.columns), F.lit(wanted))) if wanted else some

    def drop(self) -> None:
        remove(self.rows.sparkSession, self.path)
