"""Streaming versions of the request, progress and ingestion rules. Each takes and gives streaming frames, or tables.

Streams keep their state with transformWithStateInPandas, so a session that runs them needs the RocksDB state store provider.
Tables take segmented scans (operators/scan.py): a key with most of the rows is divided. Late data is this library's own policy:
a watermark of ten minutes; later rows are dropped, and counted by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from postloom.operators.metrics import BUCKETS, bucket_counts, histogram_quantile
from postloom.operators.scan import NO_TIME, Spaced, running, spaced

LATE = "10 minutes"
#: What a rule makes of some rows of a key, from their times, which of them are chosen and what was held before: the rows that stay, and its columns.
Give = Callable[[np.ndarray, np.ndarray, tuple | None], tuple[np.ndarray, list]]


def _visits(times: np.ndarray, chosen: np.ndarray, held: tuple | None) -> tuple[np.ndarray, list]:
    first = np.zeros(len(times), bool)
    first[chosen] = True
    nth = np.cumsum(first)
    opened = np.concatenate([[held[0] if held else NO_TIME], times[chosen]])[nth]
    return np.arange(len(times)), [np.where(opened == NO_TIME, np.datetime64("NaT"), opened.astype("datetime64[us]")), first]


def _only_chosen(times: np.ndarray, chosen: np.ndarray, held: tuple | None) -> tuple[np.ndarray, list]:
    return chosen, []


class _Chosen(StatefulProcessor):
    """A rule of rows chosen by time, on a stream. State is one row for each key; with `keep`, it goes so long after the time that
    `since` takes of it, by a timer of event time."""

    def __init__(self, rule: Spaced, time: str, kind: str, columns: list[str], made: list[str], give: Give, keep: int | None, since: int) -> None:
        self.rule, self.time, self.kind, self.columns, self.made, self.give, self.keep, self.since = rule, time, kind, columns, made, give, keep, since

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", f"opened long, shown {self.kind}, seen long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(rows)).sort_values(self.time, kind="stable", na_position="first")
        stamps = b[self.time].to_numpy("datetime64[us]")
        times = np.where(np.isnat(stamps), NO_TIME, stamps.astype(np.int64))
        values = None if self.rule.value is None else np.array([*(None if v is None or v != v else v for v in b[self.rule.value]), None], object)[:-1]
        *held, timer = self.state.get() if self.state.exists() else (None,) * 4
        held = tuple(held) if held[2] is not None else None
        chosen, after = self.rule.chosen(times, values, held)
        after = (*after[:2], max(after[2], held[2]) if held else after[2])
        if self.keep is not None:
            at = max((after[self.since] + self.keep) // 1000, timerValues.getCurrentWatermarkInMs() + 1)
            if at != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(at)
            timer = at
        self.state.update((*after, timer))
        stay, more = self.give(times, chosen, held)
        yield b.iloc[stay].assign(**dict(zip(self.made, more)))[[*self.columns, *self.made]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _schema(df: DataFrame, made: str = "") -> str:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return f"{kept}, {made}" if made else kept


def _by_rule(df: DataFrame, key: str, time: str, rule: Spaced, made: str, give: Give, keep: int | None, since: int = 0) -> DataFrame:
    """The rows that a rule gives: of a stream, batch by batch, with state; of a table, by a segmented scan.

    A null key is a key. Rows of a stream are in order within a batch; what comes later is taken as it comes.
    """
    if not df.isStreaming:
        return spaced(df, key, time, rule, made, give)
    late = df if keep is None else df.withWatermark(time, LATE)
    kind = df.schema[rule.value].dataType.simpleString() if rule.value else "string"
    processor = _Chosen(rule, time, kind, df.columns, [x.split()[0] for x in made.split(", ") if x], give, keep, since)
    return late.groupBy(key).transformWithStateInPandas(processor, _schema(df, made), "append", "none" if keep is None else "eventTime")


def served(visits: DataFrame, ttl: float) -> DataFrame:
    """Visits (key, ts, ...) with served_from, the time of the visit that opened the key's window, and first, if it did so.

    A window lasts `ttl` seconds from its first visit and does not slide. State is one time for each key, which leaves when
    the watermark passes its window.
    """
    wait = int(ttl * 1_000_000)
    return _by_rule(visits, "key", "ts", Spaced(wait), "served_from timestamp, first boolean", _visits, wait)


def once_per_window(requests: DataFrame, seconds: float = 300) -> DataFrame:
    """Of each key's requests (key, ts, ...) the first, and the first that comes so many seconds after the last one let through."""
    return served(requests, seconds).where("first").drop("served_from", "first")


def throttled(progress: DataFrame, seconds: float = 1.0, forget: float | None = None) -> DataFrame:
    """Progress rows (job_id, ts, counters, ...) that differ from the last row let through, and come a second after it at least.

    The first row of a job always goes through. State is the last row of each job. With `forget`, a job that is silent for so
    many seconds is forgotten, on a stream by a timer of event time: its next row is a first one. Without it, what a job says
    after any time is compared, and its state stays.
    """
    long = None if forget is None else int(forget * 1_000_000)
    return _by_rule(progress, "job_id", "ts", Spaced(int(seconds * 1_000_000), "counters", long), "", _only_chosen, long, 2)


class _Takes(StatefulProcessor):
    """Rounds of a source until its cap, or so many without an item. State is one row for each source."""

    def __init__(self, most: int, stale_rounds: int, silent: int | None) -> None:
        self.most, self.stale_rounds, self.silent = most, stale_rounds, silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "total long, stale long, done boolean", self.silent)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(rows)).sort_values("round", kind="stable")
        total, stale, done = self.state.get() if self.state.exists() else (0, 0, False)
        out = []
        for n in b["items"].fillna(0).astype("int64"):
            if done:
                break
            take = min(n, self.most - total)
            total, stale = total + take, 0 if n else stale + 1
            reason = "stale" if stale >= self.stale_rounds else "item_cap" if total >= self.most else None
            done = reason is not None
            out.append((take, reason))
        self.state.update((int(total), int(stale), done))
        b = b.iloc[: len(out)]
        yield b[["source", "round"]].assign(taken=[t for t, _ in out], stop_reason=pd.Series([r for _, r in out], b.index, object))

    def close(self) -> None:
        pass


def capped(items: DataFrame, most: int, stale_rounds: int = 3, silent: float | None = None) -> DataFrame:
    """Of each source's rounds (source, round, items), those that go on: until the cap, or so many rounds without an item.

    A null number of items is none. On a stream, state of a source that is silent for `silent` seconds of the clock goes.
    """
    items = items.select("source", "round", "items")
    if items.isStreaming:
        kinds = {f.name: f.dataType.simpleString() for f in items.schema}
        schema = f"source {kinds['source']}, round {kinds['round']}, taken long, stop_reason string"
        long = None if silent is None else int(silent * 1000)
        return items.groupBy("source").transformWithStateInPandas(_Takes(most, stale_rounds, long), schema, "append", "none" if long is None else "processingTime")
    n = F.coalesce("items", F.lit(0))
    rows = running(items, "source", ["round"], sums={"total": n, "place": F.lit(1)}, since={"streak": n != 0})
    reason = F.when(F.col("streak") >= stale_rounds, "stale").when(F.col("total") >= most, "item_cap")
    rows = rows.withColumn("stop_reason", reason)
    stops = rows.where("stop_reason is not null").groupBy(F.col("source").alias("stopped")).agg(F.min("place").alias("stop"))
    rows = rows.join(stops, F.col("source").eqNullSafe(F.col("stopped")), "left").where("stop is null or place <= stop")
    upto = lambda x: F.least(x, F.lit(most))
    return rows.select("source", "round", (upto(F.col("total")) - upto(F.col("total") - n)).cast("long").alias("taken"), "stop_reason")


def rates(events: DataFrame, ends: tuple[float, ...] | None = BUCKETS) -> DataFrame:
    """T5: request rates, shares of failures and percentiles over five minutes, each minute. events: ts, path, failed, value.

    Percentiles are those of a histogram, so state is a few counts for each window. Without ends, which only tables can do, they
    are exact: the least value that 95 of 100 values do not exceed.
    """
    if ends is None:
        return _exact_rates(events)
    slid = events.withWatermark("ts", LATE) if events.isStreaming else events
    out = slid.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("bad"), bucket_counts(F.col("value"), ends).alias("counts"))
    p95 = histogram_quantile(0.95, F.col("counts"), ends)
    return out.select(F.col("w.start").alias("start"), (F.col("n") / 300).alias("rate"), (F.col("bad") / F.greatest(F.col("n"), F.lit(1))).alias("failure_share"), p95.alias("p95"))


def _exact_rates(events: DataFrame) -> DataFrame:
    """rates() of a table: values of a window are counted, equal ones together, and ranked by running sums of those counts."""
    by_value = events.groupBy(F.window("ts", "5 minutes", "1 minute")["start"].alias("start"), "value").agg(F.count(F.lit(1)).alias("__n"), F.count_if("failed").alias("__bad"), F.count("value").alias("__k"))
    own = Window.partitionBy("start")
    ranked = by_value.withColumns({"__upto": F.sum("__k").over(own.orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__k").over(own)})
    rank = F.greatest(F.lit(1), F.col("__all") - F.expr("__all * 5 div 100"))
    out = ranked.groupBy("start").agg(F.sum("__n").alias("n"), F.sum("__bad").alias("bad"), F.min(F.when((F.col("__k") > 0) & (F.col("__upto") >= rank), F.col("value"))).alias("p95"))
    return out.select("start", (F.col("n") / 300).alias("rate"), (F.col("bad") / F.col("n")).alias("failure_share"), "p95")


def alerts(windows: DataFrame, most: float = 0.05, rounds: int = 5) -> DataFrame:
    """T5: windows at which the share of failures has been over the limit in each of the last minutes, of a batch of rates().

    Each window over the limit speaks for itself and the minutes after it, so that no task needs all windows in order.
    """
    said = windows.where(F.col("failure_share") > most).select(F.explode(F.sequence("start", F.col("start") + F.make_interval(mins=F.lit(rounds - 1)), F.make_interval(mins=F.lit(1)))).alias("start"))
    return windows.join(said.groupBy("start").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == rounds), "start", "left_semi")


COUNTERS = ("discovered", "extracted", "duplicates_removed", "skipped", "failed")


def latest_counters(progress: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """T4: the newest absolute counters of each source, of a batch and of what was known. progress: job_id, source_id, seq and counters."""
    rows = progress if known is None else known.unionByName(progress)
    newest = rows.groupBy("job_id", "source_id").agg(F.max_by(F.struct("seq", *COUNTERS), "seq").alias("c"))
    return newest.select("job_id", "source_id", "c.*")


class _Newest(StatefulProcessor):
    """The newest counters of each source of a job; rows for those that a batch changes."""

    def __init__(self, keep: int | None) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("counters", "source_id long", "seq long", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(rows)).sort_values("seq", kind="stable").drop_duplicates("source_id", keep="last")
        changed = []
        for source, seq in zip(b["source_id"], b["seq"]):
            at = (int(source),)
            held = self.known.getValue(at) if self.known.containsKey(at) else None
            changed.append(held is None or seq > held[0])
            if changed[-1]:
                self.known.updateValue(at, (int(seq),))
        yield b[changed][["job_id", "source_id", "seq", *COUNTERS]]

    def close(self) -> None:
        pass


def counter_changes(progress: DataFrame, keep: float | None = None) -> DataFrame:
    """T4: of a stream of progress rows, the newest of each source whenever a batch has a newer one: a change feed.

    State is the newest number of each source of a job. With `keep`, it goes when the source has been silent for so many seconds
    of the clock; such a stream runs on without data, so its trigger has to be one of time, not availableNow.
    """
    schema = "job_id long, source_id long, seq long, " + ", ".join(f"{c} long" for c in COUNTERS)
    rows = progress.select(*[F.col(x.split()[0]).cast("long") for x in schema.split(", ")])
    ttl = None if keep is None else int(keep * 1000)
    return rows.groupBy("job_id").transformWithStateInPandas(_Newest(ttl), schema, "append", "none" if ttl is None else "processingTime")


def live_jobs(progress: DataFrame, table: str, checkpoint: str, trigger: dict | None = None, keep: float | None = None):
    """T4: appends changes of counters to a table while a stream runs, each once. latest_counters() of the table is what holds; a
    job's figures are sums over it. No batch reads or writes what earlier ones wrote."""
    return counter_changes(progress, keep).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest(posts: DataFrame, store_path: str, checkpoint: str, trigger: dict | None = None):
    """Appends a stream of posts (job_id, source_id, dedup_key, ord, ...) that the store lacks. A batch reads the filters and,
    if need be, the keys of its own sources' buckets, and has a folder of its own."""
    from postloom.sources.store import PostStore

    def append(batch: DataFrame, number: int) -> None:
        PostStore(batch.sparkSession, store_path).append(batch, number)

    return posts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
