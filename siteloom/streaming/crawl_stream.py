"""Streams over a fetch log, and their batch twins.

Each function is ``DataFrame -> DataFrame`` on a streaming or a static input;
where a stream needs state of its own, the state is a few numbers per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from siteloom.functions import urls as U

ALPHA, LEAST_GAP, WARM_UP = 0.3, 0.05, 3.0
LOOP_URLS, LOOP_DEPTHS = 25, 4


def link_counts(links: DataFrame) -> DataFrame:
    """Running inbound links of every address (update mode)."""
    return links.groupBy(U.normalize_url("href").alias("key")).agg(F.count("*").alias("inbound"))


def hourly_fetches(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Our addition: event-time counts by hour and type, late rows within a watermark."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("hour"), "event_type", "n")
    )


def loop_verdicts(log: DataFrame) -> DataFrame:
    """url, tail, depth, urls, depths, verdict of each new address with a tail:
    ``admitted`` until its tail is confirmed as a loop, ``confirming`` for the
    address that does it, ``refused`` after that.

    Addresses met again are dropped before, by address, so the state of a tail is
    two numbers and its depths, however many addresses it has.
    """
    tails = log.select("url", U.tail_of("url").alias("t")).where("t is not null").select("url", "t.tail", F.col("t.depth").cast("int").alias("depth"))

    def watch(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, urls, depths = state.get if state.exists else (False, 0, [])
        seen = set(depths)
        for chunk in chunks:
            rows = []
            for url, depth in zip(chunk["url"], chunk["depth"], strict=True):
                if done:
                    rows.append((url, key[0], depth, urls, len(seen), "refused"))
                    continue
                urls += 1
                seen.add(int(depth))
                done = urls >= LOOP_URLS and len(seen) >= LOOP_DEPTHS
                rows.append((url, key[0], depth, urls, len(seen), "confirming" if done else "admitted"))
            yield pd.DataFrame(rows, columns=["url", "tail", "depth", "urls", "depths", "verdict"])
        state.update((done, urls, sorted(seen)))

    return (
        tails.dropDuplicates(["url"])
        .groupBy("tail")
        .applyInPandasWithState(
            watch,
            "url string, tail string, depth int, urls long, depths long, verdict string",
            "done boolean, urls long, depths array<int>",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def confirm_loops(log: DataFrame) -> DataFrame:
    """tail, urls, depths as soon as a tail is confirmed as a loop."""
    return loop_verdicts(log).where("verdict = 'confirming'").select("tail", "urls", "depths")


def loop_members(verdicts: DataFrame) -> DataFrame:
    """url, tail, role of what a crawl leaves out, from the verdicts so far: addresses
    refused, and those evicted that came in before their tail was confirmed."""
    confirmed = verdicts.where("verdict = 'confirming'").select("tail")
    role = F.when(F.col("verdict") == "admitted", "evicted").otherwise("refused")
    return verdicts.join(confirmed, "tail", "left_semi").select("url", "tail", role.alias("role"))


def _followed(samples: DataFrame) -> DataFrame:
    """job, began, ts, completed, discovered of the last sample of each job, and rate:
    a fold over rows in order of job and time.

    What is held of a job is its first and last sample, the last that counted, and
    the rate.  A sample without time or count is passed over.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = kind = None

        def rows(done: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
            columns = [pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["job", "began", "ts", "completed", "discovered", "rate"])

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for job, ts, n, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or job != held[0]:
                    if held is not None:
                        done.append(held[:6])
                    held = (job, ts, ts, n, found, None, ts, n)
                    continue
                _, began, _, _, _, rate, at, count = held
                if ts - at >= LEAST_GAP:
                    now = max(0, n - count) / (ts - at)
                    rate, at, count = ALPHA * now + (1 - ALPHA) * rate if rate else now, ts, n
                held = (job, began, ts, n, found, rate, at, count)
            yield rows(done)
        if held is not None:
            yield rows([held[:6]])

    found = F.col("discovered") if "discovered" in samples.columns else F.lit(None)
    ordered = samples.select("job", F.col("ts").cast("double"), F.col("completed").cast("long"), found.cast("long").alias("discovered"))
    ordered = ordered.where("ts is not null and completed is not null")
    doubles, longs = ["began", "ts"], ["completed", "discovered"]
    schema = StructType(
        [ordered.schema["job"], *[StructField(n, DoubleType()) for n in doubles], *[StructField(n, LongType()) for n in longs], StructField("rate", DoubleType())]
    )
    return ordered.repartition("job").sortWithinPartitions("job", "ts", "completed").mapInArrow(fold, schema)


def progress_rate(samples: DataFrame) -> DataFrame:
    """job, completed, rate: the smoothed rate of each job, from samples (job, ts
    in seconds, completed)."""
    return _followed(samples).select("job", "completed", "rate")


def progress(samples: DataFrame, ceiling: int) -> DataFrame:
    """job, completed, total, share, rate, eta_seconds from samples that also tell how
    many pages are ``discovered``; no estimate within the first ``WARM_UP`` seconds."""
    total = F.least(F.coalesce("discovered", F.lit(0)), F.lit(ceiling))
    rows = _followed(samples).withColumn("total", total)
    sure = (F.col("ts") - F.col("began") >= WARM_UP) & (F.col("rate") > 0) & (F.col("total") > 0)
    left = F.greatest(F.col("total") - F.col("completed"), F.lit(0))
    return rows.select(
        "job",
        "completed",
        "total",
        F.least(F.lit(1.0), F.when(F.col("total") > 0, F.col("completed") / F.col("total")).otherwise(0.0)).alias("share"),
        F.round(F.coalesce("rate", F.lit(0.0)), 3).alias("rate"),
        F.round(F.when(sure, left / F.col("rate")), 1).alias("eta_seconds"),
    )


def recent_items(log: DataFrame, most: int = 20) -> DataFrame:
    """job, nr, item: the last items of each job (job, ts, item), the latest first."""
    order = Window.partitionBy("job").orderBy(F.desc("ts"), F.desc("item"))
    return log.select("job", F.row_number().over(order).alias("nr"), "item").where(F.col("nr") <= most)


def run_once(stream: DataFrame, mode: str, checkpoint: str, name: str) -> DataFrame:
    """All that is there now, through the stream, into files beside its checkpoint."""
    folders: dict[int, str] = {}

    def write(rows: DataFrame, batch: int) -> None:
        folders[batch] = f"{checkpoint}-rows/{batch}"
        rows.write.mode("overwrite").parquet(folders[batch])

    query = (
        stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark, made = stream.sparkSession, [folders[b] for b in sorted(folders)]
    if not made:
        return spark.createDataFrame([], stream.schema)
    # in complete mode the last batch has the whole result
    return spark.read.schema(stream.schema).parquet(*(made[-1:] if mode == "complete" else made))
