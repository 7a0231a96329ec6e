"""The five tables as Parquet: appends with dense ids, small rewrites by swapping folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens import schemas
from revlens.plans.durable import written


def dense_ids(df: DataFrame, order: str, after: int = 0, buckets: int = 64) -> DataFrame:
    """`id` = after + 1, ... in `order`. Rows are ranked within ranges and the ranges' counts are summed, so no task
    sees all rows."""
    ranged = df.repartitionByRange(buckets, order).withColumn("_p", F.spark_partition_id())
    ranged = written(ranged)
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(F.col("_p").alias("_q"), (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))  # one row per range
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return ranged.withColumn("_r", rank).join(F.broadcast(base), F.col("_p") == F.col("_q")).withColumn("id", F.col("_base") + F.col("_r") + after).drop("_p", "_q", "_base", "_r")


class Store:
    """Tables under one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, name: str) -> bool:
        fs, where = self._fs(self._at(name))
        return fs.exists(where)

    def table(self, name: str) -> DataFrame:
        """The table, empty if nothing was stored; columns that older files lack are null."""
        schema = schemas.TABLES[name]
        if not self.exists(name) and self.exists(f"{name}.old"):
            name = f"{name}.old"
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at(name))

    def next_id(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def append(self, name: str, df: DataFrame) -> None:
        """Columns of the schema by name; missing ones are null."""
        out = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name]]
        df.select(*out).write.mode("append").parquet(self._at(name))

    def rewrite(self, name: str, df: DataFrame) -> None:
        """Replaces a table: the new one is written beside it and takes its name once the old one is aside, whence `table`
        reads it if the driver was lost in between."""
        fs, new = self._fs(self._at(f"{name}.new"))
        _, old = self._fs(self._at(name))
        out = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name]]
        df.select(*out).write.mode("overwrite").parquet(self._at(f"{name}.new"))
        _, aside = self._fs(self._at(f"{name}.old"))
        if fs.exists(old):
            fs.delete(aside, True)
            fs.rename(old, aside)
        fs.rename(new, old)
        fs.delete(aside, True)

    def reset(self) -> None:
        """Empties all tables but the alerts."""
        for name in schemas.TABLES:
            if name != "alerts" and self.exists(name):
                fs, where = self._fs(self._at(name))
                fs.delete(where, True)
