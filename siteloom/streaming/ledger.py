"""What a crawl has discovered so far, kept up to date by micro-batches of fetched pages.

Each micro-batch adds its own counts as a small table named by the batch's
number, then a manifest names it; a batch that is run again after a failure
writes and names the same table.  After ``FOLD`` batches the tables are summed
into a new base.  Readers see one state: the base and the tables of the manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators import graph as G
from siteloom.sources.store import Store

FOLD = 20


class Ledger:
    """Nodes of the link graph: key, url, first, inbound, outbound, refused (null if admitted), fetched."""

    def __init__(self, spark: SparkSession, path: str, name: str = "ledger"):
        self.store, self.name = Store(spark, path), name

    @staticmethod
    def counts(pages: DataFrame, batch: int) -> DataFrame:
        """A batch's own nodes: the pages themselves and where their links lead."""
        edges = G.links(pages.select("url", "html"))
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        inbound = edges.select(F.col("href").alias("url"), one.alias("inbound"), zero.alias("outbound"), F.lit(False).alias("fetched"))
        outbound = edges.select(F.col("src").alias("url"), zero, one, F.lit(True))
        own = pages.select("url", zero, zero, F.lit(True))
        rows = inbound.union(outbound).union(own).withColumns({"first": F.lit(batch).cast("long"), "refused": G.refusal(F.col("url")), "key": U.normalize_url("url")})
        return _summed(rows)

    def add(self, pages: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: rows url, html."""
        known = self.store.manifest(self.name)
        table = f"batch-{batch:012d}"
        if batch <= known.get("seq", -1):
            return  # named already, before the stream's own checkpoint was written
        self.store.put(self.counts(pages, batch), self.name, table)
        tables = [*known.get("tables", {}).get("rows", []), table]
        if len(tables) > FOLD:
            base = f"base-{batch:012d}"
            self.store.put(_summed(self.store.spark.read.parquet(*(f"{self.store.path}/{self.name}/{t}" for t in tables))), self.name, base)
            tables = [base]
        self.store.commit(self.name, {"tables": {"rows": tables}, "seq": batch})

    def nodes(self) -> DataFrame:
        return _summed(self.store.read(self.name))

    def refusals(self) -> DataFrame:
        """refused, n: how many addresses weren't admitted, by reason."""
        return self.nodes().where("refused is not null").groupBy("refused").agg(F.count(F.lit(1)).alias("n"))

    def unclassified(self, classified: DataFrame) -> DataFrame:
        """The checkpoint: admitted nodes that ``classified`` (url) doesn't have, with nothing known of them but their links."""
        done = classified.select(U.normalize_url("url").alias("key")).distinct()
        left = self.nodes().where("refused is null").join(done, "key", "left_anti")
        return left.select(
            "key", "url", "inbound", "outbound", F.lit("UNKNOWN").alias("page_type"), F.lit("L3_LEAF_PAGE").alias("level"), F.lit(0.0).alias("confidence")
        )


def _summed(rows: DataFrame) -> DataFrame:
    """One row a key: sums, and what the first batch that met it says (its least address)."""
    seen = F.struct("first", "url")
    return rows.groupBy("key").agg(
        F.min_by("url", seen).alias("url"),
        F.min("first").alias("first"),
        F.sum("inbound").alias("inbound"),
        F.sum("outbound").alias("outbound"),
        F.min_by("refused", seen).alias("refused"),
        F.bool_or("fetched").alias("fetched"),
    )


def follow(pages: DataFrame, ledger: Ledger, checkpoint: str) -> None:
    """Take in all pages that the stream has now."""
    query = pages.writeStream.foreachBatch(ledger.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
