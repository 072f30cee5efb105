"""The fact kept as a table that grows with its files.

A store is a folder with three tables: ``files``, the names and contents that have come in;
``sums``, for each update the additive measures by fact key and flight number, appended; and ``fact``,
by month. An update reads the legs of new files only. Sums of all updates add up to those of all
legs, so the months that new files touch are made anew from the sums, and of the months beside them
only the entry and exit flags. The files are entered last: an update that failed is done again, under
a number of its own, and leaves no sums that count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.columns import OUTLIER_MIN, shift_ym
from skyledger.functions.measures import SUMMED, add_up, completed
from skyledger.operators.fact import FACT_KEYS, label_carriers
from skyledger.sources.raw import materialised, new_files

FILES = "file string, path string, bytes long, sha256 string, update string"


class FactStore:
    """The fact below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, groups: DataFrame, threshold: float = OUTLIER_MIN):
        self.spark, self.path, self.groups, self.threshold = spark, path.rstrip("/"), groups, threshold

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def files(self) -> DataFrame:
        """What has come in, by ``file, path, bytes, sha256`` and the update that read it."""
        return self.spark.read.schema(FILES).parquet(f"{self.path}/files") if self._exists("files") else self.spark.createDataFrame([], FILES)

    def fact(self) -> DataFrame:
        stored = self.spark.read.parquet(f"{self.path}/fact")
        return stored.withColumn("ym", F.col("month_key").cast("int")).drop("month_key")

    def update(self, now: DataFrame, read: Callable[[list[str]], DataFrame]) -> int:
        """Take in the files of the manifest ``now`` that have not come in yet. ``read`` gives the legs of
        a list of paths. Returns how many files were new."""
        found = new_files(now, self.files()).select("file", "path", "bytes", "sha256")
        new = found.dropDuplicates(["file", "bytes", "sha256"]).collect()  # a row a file
        if not new:
            return 0
        number = uuid.uuid4().hex
        legs = read([r["path"] for r in new]).where(F.col("universe_repl") & F.col("route").isNotNull() & F.col("ym").isNotNull())
        added = add_up(label_carriers(legs, self.groups), [*FACT_KEYS, "flight_number"], self.threshold)
        added.withColumn("update", F.lit(number)).write.mode("append").partitionBy("update").parquet(f"{self.path}/sums")
        counted = [r["update"] for r in self.files().select("update").distinct().collect()]
        sums = self.spark.read.parquet(f"{self.path}/sums").where(F.col("update").isin(*counted, number))
        touched = [r["ym"] for r in sums.where(F.col("update") == number).select("ym").distinct().collect()]  # a row a month
        self._renew(sums, touched)
        self.spark.createDataFrame([(*r, number) for r in new], FILES).write.mode("append").parquet(f"{self.path}/files")
        return len(new)

    def _renew(self, sums: DataFrame, touched: list[int]) -> None:
        """Make the facts of the months ``touched`` anew, and mend the flags of those beside them."""
        keys = [F.col(k) for k in FACT_KEYS]
        fine = sums.where(F.col("ym").isin(*touched)).groupBy(*keys, "flight_number").agg(*[F.sum(m.name).alias(m.name) for m in SUMMED])
        rows = completed(fine.groupBy(*keys).agg(*[F.sum(m.name).alias(m.name) for m in SUMMED], F.count("flight_number").alias("n_flight_numbers")))
        beside = sorted({self._shifted(m, k) for m in touched for k in (-1, 1)} - {*touched})
        around = sorted({self._shifted(m, k) for m in (*touched, *beside) for k in (-1, 1)} - {*touched})
        rows = materialised(rows, "renewed")
        present = rows.select("route", "group", "ym")
        if self._exists("fact"):
            stored = self.fact()
            rows = rows.unionByName(stored.where(F.col("ym").isin(*beside)).drop("is_entry", "is_exit"))
            present = present.unionByName(stored.where(F.col("ym").isin(*around)).select("route", "group", "ym"))
        present = present.distinct()
        near = lambda k, name: present.select("route", "group", shift_ym("ym", k).alias("ym"), F.lit(True).alias(name))
        flagged = rows.join(near(1, "_before"), ["route", "group", "ym"], "left").join(near(-1, "_after"), ["route", "group", "ym"], "left")
        flagged = flagged.withColumns({"is_entry": F.col("_before").isNull().cast("int"), "is_exit": F.col("_after").isNull().cast("int")}).drop("_before", "_after")
        ready = materialised(flagged.withColumn("month_key", F.col("ym")).drop("ym"), "flagged")  # it is read from the table it goes to
        ready.repartition("month_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month_key").parquet(f"{self.path}/fact")

    @staticmethod
    def _shifted(ym: int, k: int) -> int:
        n = ym // 100 * 12 + ym % 100 - 1 + k
        return n // 12 * 100 + n % 12 + 1
