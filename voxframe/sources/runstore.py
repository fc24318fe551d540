"""A store of model runs to which folds are published whole or not at all."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.sources.shared import exists

Part = tuple[str, int, int]
PART = ["model", "repeat", "fold"]
MANIFEST = "attempt string, at long, model string, repeat int, fold int"


class RunStore:
    """Tables of runs (scores, points, params, models or others, each with columns model, repeat and fold) in a shared folder.

    `write` puts an attempt's rows into folders of its own, where nobody sees them; `publish` names the folds they hold in
    a manifest, which Spark moves into its place as one file. A job that is killed before leaves no trace in what is read; a
    fold that is published again replaces its own rows of all tables and no others. Of two writers the later one wins. The
    driver sees one manifest row for each published fold, never rows of tables.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return self.folder if table == "scores" else f"{self.folder}-{table}"

    def write(self, **tables: DataFrame) -> str:
        """The name of a new attempt that holds the tables' rows."""
        attempt = f"a{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path(name)}/attempt={attempt}")
        return attempt

    def publish(self, attempt: str, parts: list[Part]) -> None:
        """From now on the attempt's rows of these folds are the store's, in all its tables; its rows of other folds stay unseen."""
        rows = [(attempt, time.time_ns(), *p) for p in parts]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(self.path("manifests"))

    def append(self, parts: list[Part], **tables: DataFrame) -> None:
        self.publish(self.write(**tables), parts)

    def published(self) -> DataFrame:
        """attempt, model, repeat, fold: the latest attempt of each published fold; empty where there is no store yet. A store that can't be read is an error."""
        if not exists(self.spark, self.path("manifests")):
            return self.spark.createDataFrame([], MANIFEST).drop("at")
        last = Window.partitionBy(*PART).orderBy(F.desc("at"), F.desc("attempt"))
        rows = self.spark.read.schema(MANIFEST).parquet(self.path("manifests"))
        return rows.withColumn("__nth", F.row_number().over(last)).filter("__nth = 1").select("attempt", *PART)

    def parts(self) -> set[Part]:
        return {tuple(r) for r in self.published().select(*PART).collect()}

    def read(self, table: str = "scores", schema: str | None = None) -> DataFrame:
        """The table's rows of all published folds; a table that no published attempt has written is empty, with the schema."""
        latest = self.published()
        attempts = sorted(r["attempt"] for r in latest.select("attempt").distinct().collect())
        folders = [f for a in attempts if exists(self.spark, f := f"{self.path(table)}/attempt={a}")]
        if not folders:
            if schema is None:
                raise ValueError(f"no published {table} in {self.folder}")
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.option("basePath", self.path(table)).option("mergeSchema", "true").parquet(*folders)
        return rows.join(F.broadcast(latest), ["attempt", *PART], "left_semi").drop("attempt")
