"""Reading tables, and tables written on the way to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key from which on it counts as hot.
HOT_ROWS = 500


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share. Where it is unset, a local session gets a folder
    of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sightline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: loops keep short plans, and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables written on the way of a loop, deleted once its result is written as one table."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/step-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        out = written(df)
        jvm = self.spark._jvm
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []
        return out


def unused(taken: list[str], *names: str) -> tuple[str, ...]:
    """The names, with underscores put before those that are taken already (in any case)."""
    seen, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in seen:
            name = "_" + name
        seen.add(name.lower())
        out.append(name)
    return tuple(out)


def join_spread(rows: DataFrame, table: DataFrame, on: str, how: str = "inner", most: int = 100_000) -> DataFrame:
    """rows joined with table, which has one row for each key at most (inner or left). Keys with many rows are not dealt to
    one task: of those with HOT_ROWS or more the `most` largest go by broadcast. Any other key has less
    than one part in `most` of all rows."""
    counts = rows.groupBy(on).agg(F.count(F.lit(1)).alias("n_of_key")).where(F.col("n_of_key") >= HOT_ROWS)
    hot = written(counts.orderBy(F.desc("n_of_key")).limit(most).join(table, on))
    if hot.isEmpty():
        return rows.join(table, on, how)
    keys = F.broadcast(hot.select(on))
    far = rows.join(keys, on, "left_anti").join(table, on, how)
    return far.unionByName(rows.join(F.broadcast(hot.drop("n_of_key")), on))


def broadcast_if_few(table: DataFrame, most: int = 100_000) -> DataFrame:
    """table, marked for broadcast if it has at most so many rows; else it is joined by shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
