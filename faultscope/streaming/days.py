"""Final rows of a stream in one folder per day, with a job that merges the files of days that are over."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultscope.session import remove_folders
from faultscope.sources.stores import read_or_empty


class DayTable:
    """Rows of ``schema`` below ``path``, by the day of ``time_col``; its days are those of the session's time zone.

    Each batch writes its rows to folders of its own in ``open``, so a batch that is tried again replaces them. ``compact`` moves a day
    that is over to ``closed`` and then lists it in ``over``; readers take a listed day from ``closed`` and any other
    from ``open``, so no row is seen twice, wherever a run is cut off.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, time_col: str):
        self.spark, self.path, self.schema, self.time = spark, path, schema, time_col

    def write(self, batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("day", F.to_date(self.time)).withColumn("batch", F.lit(batch_id).cast("bigint"))
        self._replace(dated, ["day", "batch"], "open")

    def follow(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Write a stream in append mode; by default all files present now, then stop."""
        return (
            stream.writeStream.outputMode("append")
            .foreachBatch(self.write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def read(self, first: datetime.date | None = None, last: datetime.date | None = None) -> DataFrame:
        """The rows of all days, or of those from ``first`` to ``last``; no file of another day is opened."""
        over = F.col("day").isin(self._over())
        found = self._open().filter(~over).drop("batch").unionByName(self._part("closed", "day date").filter(over))
        if first is not None:
            found = found.filter(F.col("day") >= F.lit(first))
        if last is not None:
            found = found.filter(F.col("day") <= F.lit(last))
        return found.drop("day")

    def compact(self, files: int = 1) -> list[datetime.date]:
        """Merge the files of every day that is over into ``files`` each; returns the days.

        In append mode a batch brings all windows that end before the watermark, so a day is over as soon as a later one has a window.
        """
        rows = self._open()
        listed = set(self._over())
        # One date per day that isn't merged yet.
        days = {r[0] for r in rows.select("day").distinct().collect()}
        closing = sorted(d for d in days - listed if d < max(days))
        if closing:
            here = rows.filter(F.col("day").isin(closing)).drop("batch")
            part = F.pmod(F.xxhash64(*[c.name for c in here.schema if c.name != "day"]), F.lit(files))
            self._replace(here.repartition("day", part), ["day"], "closed")
            self.spark.createDataFrame([(d,) for d in closing], "day date").coalesce(1).write.mode("append").parquet(f"{self.path}/over")
        remove_folders(self.spark, [f"{self.path}/open/day={d}" for d in [*closing, *(days & listed)]])
        return closing

    def _over(self) -> list[datetime.date]:
        return [r[0] for r in read_or_empty(self.spark, f"{self.path}/over", "day date").distinct().collect()]

    def _open(self) -> DataFrame:
        return self._part("open", "day date, batch bigint")

    def _part(self, name: str, more: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/{name}", f"{self.schema}, {more}")

    def _replace(self, rows: DataFrame, by: list[str], name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")
