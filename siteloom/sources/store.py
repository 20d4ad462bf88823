"""Results in versions: written first, then named by a manifest that is put in place at once.

A version is a folder of its own.  Readers see what the manifest names, so a
write that is killed, fails or is still running leaves the result before it as
it was.  Needs a file system with an atomic rename, as HDFS and local disks have.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


class Store:
    """Named results below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._java = spark._jvm.org.apache.hadoop.fs

    def manifest(self, name: str) -> dict:
        """What the result is made of now: ``tables`` by part, ``partial``, ``seq``; empty if it was never written."""
        at = self._java.Path(f"{self.path}/{name}/MANIFEST")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return {}
        stream = files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, name: str, manifest: dict) -> None:
        """Replace the manifest in one step."""
        new = self._java.Path(f"{self.path}/{name}/.manifest-{uuid.uuid4().hex}")
        conf = self.spark._jsc.hadoopConfiguration()
        out = new.getFileSystem(conf).create(new, True)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        self._java.FileContext.getFileContext(new.toUri(), conf).rename(new, self._java.Path(f"{self.path}/{name}/MANIFEST"), options)

    def write(self, df: DataFrame, name: str, partial: bool = False) -> None:
        """``df`` is the result from now on; ``partial`` marks what a job left when it was stopped."""
        table = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}/{table}")
        before = self.manifest(name)
        self.commit(name, {"tables": {"rows": [table]}, "partial": partial, "seq": before.get("seq", 0) + 1})

    def put(self, df: DataFrame, name: str, table: str) -> None:
        """Rows in a folder that no manifest names yet; written anew if it is there."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/{table}")

    def tables(self, name: str, part: str = "rows") -> list[str]:
        return [f"{self.path}/{name}/{t}" for t in self.manifest(name).get("tables", {}).get(part, [])]

    def read(self, name: str, part: str = "rows") -> DataFrame:
        found = self.tables(name, part)
        if not found:
            raise FileNotFoundError(f"no result {name}")
        return self.spark.read.parquet(*found)

    def is_partial(self, name: str) -> bool:
        return bool(self.manifest(name).get("partial", False))

    def restored(self, name: str) -> DataFrame:
        """Rows of a stored result, each with ``partial``."""
        return self.read(name).withColumn("partial", F.lit(self.is_partial(name)))


def _cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def csv_lines(df: DataFrame) -> DataFrame:
    """nr, line: rows as RFC 4180 lines in their order; line 0 is the header, with a byte
    order mark by which spreadsheets know UTF-8.  Nulls and empty texts are empty cells."""
    from siteloom.operators.ranking import running

    rows = df.select(F.concat_ws(",", *(_cell(F.col(f"`{c}`")) for c in df.columns)).alias("line"), F.monotonically_increasing_id().alias("_order"))
    lines = running(rows, [], [F.col("_order").asc()], drop=["_order"], rank="nr").select("nr", "line")
    header = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("nr"), F.lit(BOM + ",".join(df.columns)).alias("line"))
    return header.union(lines)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``csv_lines`` as text files: read by name, they are the download."""
    lines = csv_lines(df).repartitionByRange(F.col("nr")).sortWithinPartitions("nr")
    lines.select("line").write.mode(mode).option("lineSep", "\r\n").text(path)
