"""Segmented scans: what depends on all earlier rows of a key, though one key may hold most of the rows.

Rows are divided into ranges of (key, order), which are written, so that a block is the same rows whenever it is read; a key with
many rows lies in many blocks. Each block is folded into a summary that can be put behind another; the summaries of a key are
taken in order, which gives the state that each block starts from; blocks are then run from there. Only a key that goes on
from the block before needs a state, so a block has one such at most, and all states together are as many as blocks.

running() is native, for sums, maxima, streaks and the row before; spaced() is for rules that count time from a row that they
have chosen themselves, whose summary is a table: who is chosen last, by who is chosen first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.shared import checkpointed


def fresh(columns: list[str], name: str) -> str:
    """A name that no column has, in any case."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def blocks(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df in written partitions, each a range of key and order, and sorted."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order))


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, Column] | None = None, peaks: dict[str, Column] | None = None, since: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """df with figures over the rows of its key up to and with each row.

    sums and peaks: of numbers, null as nothing. since: rows after the last one whose flag is true, the row among them. before:
    a value of the row before, null for the first. order has to tell a key's rows apart; a null key is a key.
    """
    sums, peaks, since, before = sums or {}, peaks or {}, since or {}, before or {}
    made = [*sums, *peaks, *since, *before]
    name = lambda x: fresh([*df.columns, *made], f"__{x}")
    block, at, size, start, of, of_block = map(name, ("block", "at", "size", "start", "of", "of_block"))
    own, carried, lagged = ({c: name(f"{kind}_{c}") for c in made} for kind in ("own", "carried", "lagged"))

    rows = blocks(df, key, order).withColumn(block, F.spark_partition_id())
    inside = Window.partitionBy(key, block).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(at, F.row_number().over(inside).cast("long"))
    rows = rows.withColumns(
        {own[c]: F.coalesce(F.sum(x).over(upto), F.lit(0)) for c, x in sums.items()} | {own[c]: F.max(x).over(upto) for c, x in peaks.items()}
        | {own[c]: F.max(F.when(x, F.col(at))).over(upto) for c, x in since.items()} | {own[c]: x for c, x in before.items()} | {lagged[c]: F.lag(x).over(inside) for c, x in before.items()}
    )

    # a block's summary is what its last row has; those before it make what the block starts from
    summary = rows.groupBy(key, block).agg(F.max_by(F.struct(F.col(at).alias(size), *own.values()), at).alias(start)).select(key, block, f"`{start}`.*")
    of_key = Window.partitionBy(key).orderBy(block)
    earlier = of_key.rowsBetween(Window.unboundedPreceding, -1)
    state = summary.withColumn(start, F.sum(size).over(earlier)).withColumns(
        {carried[c]: F.sum(own[c]).over(earlier) for c in sums} | {carried[c]: F.max(own[c]).over(earlier) for c in peaks}
        | {carried[c]: F.max(F.coalesce(start, F.lit(0)) + F.col(own[c])).over(earlier) for c in since} | {carried[c]: F.lag(own[c]).over(of_key) for c in before}
    )
    state = state.where(F.col(start).isNotNull()).select(F.col(key).alias(of), F.col(block).alias(of_block), start, *carried.values())  # no more rows than blocks
    out = rows.join(F.broadcast(state), F.col(key).eqNullSafe(F.col(of)) & (F.col(block) == F.col(of_block)), "left")
    begin = F.coalesce(start, F.lit(0))
    return out.select(
        *df.columns, *[(F.col(own[c]) + F.coalesce(carried[c], F.lit(0))).alias(c) for c in sums], *[F.greatest(own[c], carried[c]).alias(c) for c in peaks],
        *[(begin + F.col(at) - F.coalesce(begin + F.col(own[c]), F.col(carried[c]), F.lit(0))).alias(c) for c in since], *[F.when(F.col(at) == 1, F.col(carried[c])).otherwise(F.col(lagged[c])).alias(c) for c in before],
    )


@dataclass(frozen=True)
class Spaced:
    """The rule of rows that are chosen by time since the one chosen last.

    A key's first row is chosen, and each row that comes `wait` microseconds after the last chosen one at least, and has another
    value than that one where `value` names a column. With `forget`, so is a row that comes so long after the row before it.
    """

    wait: int
    value: str | None = None
    forget: int | None = None

    def nexts(self, times: np.ndarray, values: np.ndarray | None) -> np.ndarray:
        """For each row, the row chosen next if it is chosen; their number where there is none."""
        n = len(times)
        at = np.maximum(np.searchsorted(times, times + self.wait), np.arange(1, n + 1))
        if values is not None:
            run = _runs(values)
            same = at < n
            same[same] = values[at[same]] == values[same]
            at[same] = run[at[same]]
        gaps = np.append(self.gaps(times), n)
        return np.minimum(at, gaps[np.searchsorted(gaps, np.arange(n), "right").clip(max=len(gaps) - 1)])

    def gaps(self, times: np.ndarray) -> np.ndarray:
        """Rows that come so long after the one before that nothing is known of the key any more."""
        return np.flatnonzero(np.diff(times) >= self.forget) + 1 if self.forget is not None else np.zeros(0, np.int64)

    def first(self, times: np.ndarray, values: np.ndarray | None, held: tuple | None) -> int:
        """The first row chosen, from what is held of the key: time and value of the last chosen row, time of the last row."""
        if held is None or self.forget is not None and times[0] - held[2] >= self.forget:
            return 0
        at = int(np.searchsorted(times, held[0] + self.wait))
        if values is not None and at < len(times) and values[at] == held[1]:
            at = int(_runs(values)[at])
        return int(min([at, *self.gaps(times)[:1]]))

    def chosen(self, times: np.ndarray, values: np.ndarray | None, held: tuple | None) -> tuple[np.ndarray, tuple]:
        """The rows chosen, and what is held then."""
        at, out = self.first(times, values, held), []
        if at < len(times):
            nexts = self.nexts(times, values).tolist()
            while at < len(times):
                out.append(at)
                at = nexts[at]
        opened, shown = (int(times[out[-1]]), None if values is None else values[out[-1]]) if out else held[:2]
        return np.array(out, np.int64), (opened, shown, int(times[-1]))


def _runs(values: np.ndarray) -> np.ndarray:
    """For each row, where the next other value begins."""
    n = len(values)
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, n)
    return ends[np.searchsorted(ends, np.arange(n), "right")]


#: What a missing time counts as: before all others, as it is sorted.
NO_TIME = -(2**62)


def _segments(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """Each batch's rows by key, in order; a null key is None."""
    for b in batches:
        codes = pc.fill_null(b.column(key).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else []
        for a, z in zip(edges, edges[1:]):
            yield b.column(key)[a].as_py(), b.slice(a, z - a)


def _read(b: pa.RecordBatch, time: str, rule: Spaced) -> tuple[np.ndarray, np.ndarray | None]:
    times = pc.fill_null(pc.cast(b.column(time), pa.int64()), NO_TIME).to_numpy(zero_copy_only=False)
    return times, None if rule.value is None else np.array([*b.column(rule.value).to_pylist(), None], object)[:-1]


def _summaries(key: str, time: str, rule: Spaced, types: list[pa.DataType]):
    """Of the first and the last key of a block: for each kind of row that may be chosen first, which one is chosen last.

    Rows in a row that have one value and lead to the same last one are one kind, which stands for the latest of them.
    """

    def table(value, parts: list[tuple], block: int) -> pa.RecordBatch:
        times, values = np.concatenate([t for t, _ in parts]), None if rule.value is None else np.concatenate([v for _, v in parts])
        last = rule.nexts(times, values)
        last = np.where(last < len(times), last, np.arange(len(times)))
        while not np.array_equal(last, last[last]):
            last = last[last]
        forced = np.zeros(len(times), bool)
        forced[rule.gaps(times)] = True
        ends = np.append(last[1:] != last[:-1], True)
        ends[:-1] |= forced[1:] | forced[:-1]
        if values is not None:
            ends[:-1] |= values[1:] != values[:-1]
        at, n = np.flatnonzero(ends), int(ends.sum())
        shown = lambda k: [None] * n if values is None else values[k].tolist()
        columns = [[value] * n, [block] * n, range(n), times[at], shown(at), forced[at], times[last[at]], shown(last[at]), [times[0]] * n, [times[-1]] * n]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, now, first = TaskContext.get().partitionId(), [], None, True
        for value, part in _segments(batches, key):
            if held and value != now:
                if first:
                    yield table(now, held, block)
                held, first = [], False
            now = value
            held.append(_read(part, time, rule))
        if held:
            yield table(now, held, block)

    return run


_SUMMARY = ["key", "block", "place", "upto", "value", "forced", "opened", "shown", "begins", "seen"]


def _starts(rule: Spaced, types: list[pa.DataType]):
    """What each block of a key starts from, but for the first; blocks' summaries come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, start, held, entered, free = (), None, None, None, False, True
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["key"],) != now:
                    now, block, held = (r["key"],), None, None
                if r["block"] != block:
                    block, start, entered = r["block"], held, False
                    free = start is None or rule.forget is not None and r["begins"] - start[2] >= rule.forget
                    if start is not None:
                        out.append((block, *start))
                        held = (*start[:2], r["seen"])
                if not entered and (free or r["forced"] or r["upto"] >= start[0] + rule.wait and (rule.value is None or r["value"] != start[1])):
                    held, entered = (r["opened"], r["shown"], r["seen"]), True
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, types)], ["block", "opened", "shown", "seen"])

    return run


def spaced(df: DataFrame, key: str, time: str, rule: Spaced, made: str, give) -> DataFrame:
    """What a rule gives for each key's rows in order of time: give(times, chosen, held before) is the rows that stay, with the
    values of the columns `made`. A task holds the times (and values) of one key in one block, and a batch of rows.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    value = kinds[rule.value].simpleString() if rule.value else "string"
    rows = blocks(df, key, [time])
    summary_schema = f"key {kinds[key].simpleString()}, block int, place int, upto long, value {value}, forced boolean, opened long, shown {value}, begins long, seen long"
    start_schema = f"block int, opened long, shown {value}, seen long"
    summary = rows.mapInArrow(_summaries(key, time, rule, _arrow(df, summary_schema)), summary_schema)
    starts = summary.repartition("key").sortWithinPartitions("key", "block", "place").mapInArrow(_starts(rule, _arrow(df, start_schema)), start_schema)
    begin = {r["block"]: (r["opened"], r["shown"], r["seen"]) for r in starts.collect()}  # one for each block at most
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    schema = f"{kept}, {made}" if made else kept
    types = _arrow(df, made) if made else []
    names = [*df.columns, *[x.split()[0] for x in made.split(", ") if x]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, first = (), None, True
        for value, part in _segments(batches, key):
            if (value,) != now:
                now, held, first = (value,), begin.get(TaskContext.get().partitionId()) if first else None, False
            times, values = _read(part, time, rule)
            chosen, after = rule.chosen(times, values, held)
            stay, more = give(times, chosen, held)
            part = part.take(pa.array(stay, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, t) for c, t in zip(more, types)]], names)
            held = after

    return rows.mapInArrow(run, schema)


def _arrow(df: DataFrame, schema: str) -> list[pa.DataType]:
    """The Arrow types of columns."""
    return df.sparkSession.createDataFrame([], schema).toArrow().schema.types
