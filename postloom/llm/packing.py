"""Best-fit packing by minimum bin slack over token lengths.

Each bin takes the longest length that is left and then the fullest combination of the other lengths that fits, found by
subset-sum dynamic programming over a bitset of reachable sums. Which documents have a length makes no difference to a bin,
so the plan is made on the histogram of lengths, which has at most `capacity` entries at any input size: a combination is
repeated as often as the counts of its lengths allow. Documents get their places from their rank within their length.

Defined results: a null text is empty and packs as the end id alone; repeated rows and null ids are packed one by one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import cut, ranked, table
from postloom.llm.token_counts import known_codes, slices, tokenizer, word_codes

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
#: Words whose ids one worker keeps before it begins anew. What is kept changes the time, never the ids.
KEPT = 500_000


class WordIds:
    """Ids of texts for a tokenizer that drops white space: a text's ids are its words' ids in order."""

    def __init__(self, name: str = TOKENIZER, kept: int = KEPT) -> None:
        self.library, self.kept = tokenizer(name), kept
        self.index: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.index.clear()  # in place: known_codes() goes on with the same dictionary
        self.flat, self.start, self.size, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        got = self.library.encode(" ".join(words), add_special_tokens=False)  # one call; offsets tell the words apart
        ids, n = np.array(got.ids, np.uint32), len(self.index)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        cuts = np.searchsorted(np.array([a for a, _ in got.offsets], np.int64), ends)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < n + len(words):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + len(words)] = np.diff(cuts, prepend=0)
        self.start[n : n + len(words)] = self.used + np.concatenate([[0], cuts[:-1]])
        self.used += len(ids)
        self.index.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin."""
        texts = pc.fill_null(texts, "")
        for c in "\n\t\r":
            texts = pc.replace_substring(texts, c, " ")
        # Letters and the marks after them are split anyway, and case is dropped: fewer distinct words. A text keeps its case
        # where case may matter: before a combining mark, to the tokenizer's normal form, and in what looks like a special
        # token, which is one in lower case only. Each text by itself: its neighbours never change its ids.
        as_it_is = pc.match_substring_regex(texts, "\\p{M}|<\\|")
        texts = pc.if_else(as_it_is, texts, pc.ascii_lower(texts))
        texts = pc.replace_substring_regex(texts, "([A-Za-z])([,.;:!?]+)", "\\1 \\2")
        words, code, begins = word_codes(texts)
        if not len(code):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        code = known_codes(self.index, words.to_pylist(), self.kept, self._learn, self.forget)[code]
        size = self.size[code]
        ends = np.cumsum(size)
        at = np.repeat(self.start[code] - (ends - size), size) + np.arange(int(ends[-1]))
        return self.flat[at], np.concatenate([[0], ends])[begins]


_ENCODERS: dict[str, WordIds] = {}


def encoder(name: str) -> WordIds:
    if name not in _ENCODERS:
        _ENCODERS[name] = WordIds(name)
    return _ENCODERS[name]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths (with how many of each) whose sum is the largest that is at most `room`."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        copies, left = 1, min(counts[length], room // length)
        while left > 0:
            take = min(copies, left)
            more = (reach | reach << (take * length)) & mask
            if more != reach:
                steps.append((reach, length, take))
                reach = more
            left, copies = left - take, copies * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= take * length
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, how many bins of it), in the order in which they are taken."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        bin_ = fullest(counts, capacity - seed)
        counts[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(counts[n] // k for n, k in bin_.items())
        for n, k in bin_.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        out.append((bin_, times))
    return out


def places(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, how many in a bin, first bin, offset in the bin), by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for bin_, times in bins:
        offset = 0
        for n in sorted(bin_, reverse=True):
            out.setdefault(n, []).append((used.get(n, 0), bin_[n], first, offset))
            used[n] = used.get(n, 0) + bin_[n] * times
            offset += n * bin_[n]
        first += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pieces(docs: DataFrame, name: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each document, or for each `capacity` ids of a longer one: doc_id, piece, start, length, ids_crc32[, ids]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        for part in (x for batch in batches for x in slices(batch)):
            ids, begins = encoder(name).encode(part.column("text"))
            rows: list[tuple] = []
            for doc_id, a, z in zip(part.column("doc_id").to_pylist(), begins.tolist(), begins[1:].tolist()):
                raw = ids[a:z].astype("<u4").tobytes() + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    piece = raw[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), *([np.frombuffer(piece, "<u4")] if with_ids else [])))
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    names, types = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    if with_ids:
        names, types = [*names, "ids"], [*types, pa.list_(pa.int64())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, name: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents with sequence_id (gapless from 0) and offset, in as few sequences as minimum bin slack finds."""
    rows = cut(pieces(docs, name, capacity, with_ids))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    where = places(plan(histogram, capacity))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank, length = b["__rank"].to_numpy(np.int64), b["length"].to_numpy(np.int64)
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for n in np.unique(length):
                at, spots = np.flatnonzero(length == n), where[int(n)]
                spot = spots[np.searchsorted(spots[:, 0], rank[at], "right") - 1]
                inside = rank[at] - spot[:, 0]
                sequence[at], offset[at] = spot[:, 2] + inside // spot[:, 1], spot[:, 3] + inside % spot[:, 1] * n
            yield b.drop(columns="__rank").assign(sequence_id=sequence, offset=offset)

    order = ["doc_id", "piece", "ids_crc32"]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return ranked(rows, "length", order, "__rank").select(*columns, "__rank").mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def sequences(docs: DataFrame, name: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most `capacity`), doc_ids in their order."""
    rows = pack(docs, name, capacity, with_ids=True)
    parts = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts"))  # at most `capacity` rows a sequence
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
