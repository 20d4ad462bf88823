"""Stateful streams: the progress of jobs, and loops as they are discovered.

Both keep their state in Spark's state store (RocksDB, set by ``use_rocksdb``),
a few values per key or a map on disk, and drop it when it is done with.

Timers and times to live follow the clock, so a stream that has them makes
batches for as long as it runs.  A run over what there is now, which ends by
itself, goes without: ``idle`` or ``keep`` is None.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siteloom.functions import urls as U

from .crawl_stream import ALPHA, LEAST_GAP, LOOP_DEPTHS, LOOP_URLS, WARM_UP

RECENT = 20
PROGRESS = (
    "job string, samples long, ts double, completed long, total long, share double, rate double, eta_seconds double, recent array<string>, ended boolean"
)
VERDICTS = "url string, tail string, depth int, verdict string"


def use_rocksdb(spark: SparkSession) -> None:
    """State of these streams needs a store that holds maps and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _clock(seconds: float | None) -> str:
    return "None" if seconds is None else "ProcessingTime"


class Progress(StatefulProcessor):
    """Rate, estimate and last items of one job.

    State: the first and last sample, the last that counted, the rate, and the
    last ``RECENT`` items.  A job without samples for ``idle`` seconds gets a last
    row, marked ``ended``, and its state goes.
    """

    def __init__(self, ceiling: int, idle: float | None):
        self.ceiling, self.idle = ceiling, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState(
            "last", "samples long, began double, ts double, completed long, discovered long, rate double, at double, counted long"
        )
        self.items = handle.getValueState("items", "recent array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a job's samples of one micro-batch, which the trigger bounds
        new = pd.concat(list(rows)).dropna(subset=["ts", "completed"]).sort_values(["ts", "completed"], kind="stable")
        if new.empty:
            return
        held = self.last.get() if self.last.exists() else None
        recent = list(self.items.get()[0]) if self.items.exists() else []
        for ts, n, found, item in zip(new["ts"], new["completed"], new["discovered"], new["item"], strict=True):
            n, found = int(n), None if pd.isna(found) else int(found)
            recent = [*recent, item][-RECENT:] if isinstance(item, str) else recent
            if held is None:
                held = (1, ts, ts, n, found, None, ts, n)
                continue
            samples, began, last, _, _, rate, at, counted = held
            if ts < last:
                continue  # a sample that comes after a later one says nothing new
            if ts - at >= LEAST_GAP:
                now = max(0, n - counted) / (ts - at)
                rate, at, counted = ALPHA * now + (1 - ALPHA) * rate if rate else now, ts, n
            held = (samples + 1, began, ts, n, found, rate, at, counted)
        self.last.update(held)
        self.items.update((recent,))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield self.row(key[0], held, recent, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield self.row(key[0], self.last.get(), list(self.items.get()[0]), True)
        self.last.clear()
        self.items.clear()

    def row(self, job, held, recent: list[str], ended: bool) -> pd.DataFrame:
        samples, began, ts, n, found, rate, _, _ = held
        total = min(found or 0, self.ceiling)
        share = min(1.0, n / total) if total > 0 else 0.0
        sure = ts - began >= WARM_UP and rate and total > 0
        eta = round(max(total - n, 0) / rate, 1) if sure else None
        return pd.DataFrame(
            {
                "job": [job], "samples": [samples], "ts": [ts], "completed": [n], "total": [total], "share": [share],
                "rate": [round(rate or 0.0, 3)], "eta_seconds": pd.Series([eta], dtype="float64"), "recent": [recent], "ended": [ended],
            }
        )

    def close(self) -> None:
        pass


def live_progress(samples: DataFrame, ceiling: int, idle: float | None = 3600.0) -> DataFrame:
    """A row for each job and micro-batch from samples (job, ts in seconds, completed,
    discovered, item): how far it is, its smoothed rate, time left and last items."""
    rows = samples.select(
        F.col("job").cast("string"), F.col("ts").cast("double"), F.col("completed").cast("long"), F.col("discovered").cast("long"), F.col("item").cast("string")
    )
    return rows.groupBy("job").transformWithStateInPandas(Progress(ceiling, idle), PROGRESS, "Update", _clock(idle))


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each job."""
    return rows.groupBy("job").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "job"]), "samples").alias("r")).select("job", "r.*")


class Loops(StatefulProcessor):
    """Addresses under one tail until it is confirmed as a loop; then only that it is.

    The addresses are a map in the state store, each for ``keep`` seconds after it
    was met at most; they leave the stream as evictions when the tail is confirmed.
    """

    def __init__(self, keep: float | None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.keep is None else int(self.keep * 1000)
        self.urls = handle.getMapState("urls", "url string", "depth int", ttl)
        self.counts = handle.getMapState("counts", "depth int", "n long", ttl)
        self.confirmed = handle.getValueState("confirmed", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.confirmed.exists()
        depths = {} if done else {k[0]: v[0] for k, v in self.counts.iterator()}
        for chunk in rows:
            out = []
            for url, depth in zip(chunk["url"], chunk["depth"].astype(int), strict=True):
                if done:
                    out.append((url, depth, "refused"))
                    continue
                if self.urls.containsKey((url,)):
                    continue
                self.urls.updateValue((url,), (depth,))
                depths[depth] = depths.get(depth, 0) + 1
                self.counts.updateValue((depth,), (depths[depth],))
                if sum(depths.values()) < LOOP_URLS or len(depths) < LOOP_DEPTHS:
                    out.append((url, depth, "admitted"))
                    continue
                done = True
                out.append((url, depth, "confirming"))
                out += [(k[0], v[0], "evicted") for k, v in self.urls.iterator() if k[0] != url]
                self.confirmed.update((True,))
                self.urls.clear()
                self.counts.clear()
            if out:
                made = pd.DataFrame(out, columns=["url", "depth", "verdict"])
                made.insert(1, "tail", key[0])
                yield made

    def close(self) -> None:
        pass


def discovered_loops(log: DataFrame, keep: float | None = 7 * 86400.0) -> DataFrame:
    """url, tail, depth, verdict of addresses as they are discovered: ``admitted``; for the
    one that confirms its tail as a loop ``confirming``, and ``evicted`` for those admitted
    before it; ``refused`` after that."""
    tails = log.select("url", U.tail_of("url").alias("t")).where("t is not null").select("url", "t.tail", F.col("t.depth").cast("int").alias("depth"))
    return tails.groupBy("tail").transformWithStateInPandas(Loops(keep), VERDICTS, "Append", _clock(keep))
