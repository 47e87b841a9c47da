"""Helpers that the corpus operators have in common: the shared folder, written tables, batches."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task holds as Python objects at once; texts may be long.
BATCH_ROWS = 256
#: Rows that Spark hands to Python at once, set for the session: its default, 10,000 whole texts, fills executors.
ARROW_ROWS = 2_048


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder
    of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sightline-"))
            held = spark.sparkContext.getCheckpointDir()
        found = held
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives the loss of an executor."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are deleted as soon as it has ended. Otherwise they stay until the driver next
    collects its garbage, however large they are. For steps that end in written tables and are not run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_table(df: DataFrame) -> None:
    """Delete the folder of a table made by write_table, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        delete_folder(df.sparkSession, files[0].rpartition("/")[0])


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with underscores put before those that df has as columns already (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def text_of(column: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


#: Rows of a key from which on it counts as hot, and hot keys that are broadcast at most.
HOT_ROWS, HOT_KEYS = 500, 200_000


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", n: str = "n") -> DataFrame:
    """rows joined with table, which has one row per key with the number n of the rows of that key. The join is inner or
    left.

    A key with a large share of the rows is not dealt to one task: keys with n >= max(HOT_ROWS, sum(n) / HOT_KEYS) are
    HOT_KEYS at most, so they are broadcast, and their rows stay where they are.
    """
    many = max(HOT_ROWS, -(-(table.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS))
    hot = table.where(F.col(n) >= many)
    if hot.isEmpty():
        return rows.join(table, on, how)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.where(F.col(n) < many), on, how)
    return far.unionByName(near)


def in_blocks(rows: DataFrame, key: str, row_id: str, size: int) -> DataFrame:
    """Cut groups of rows (key, row_id, open, ...) into parts of at most about size rows, such that every row that is
    open meets every row of its key in some part; rows that are not open need not meet each other. Adds part (long).

    Rows are dealt to chunks by a hash of row_id; a part is a chunk of the open rows with a chunk of all rows.
    """
    half = max(1, size // 2)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open")).where("n_open > 0")
    chunks = lambda c: F.ceil(F.col(c) / half).cast("int")
    dealt = join_counted(rows, counts, [key]).withColumn("of_all", F.pmod(F.xxhash64(row_id, key), chunks("n")).cast("long"))
    dealt = dealt.withColumn("of_open", F.pmod(F.xxhash64(row_id, key, F.lit(1)), chunks("n_open")).cast("long"))
    part = lambda a, b: a * (1 << 31) + b
    among_open = F.transform(F.sequence(F.lit(0), chunks("n_open") - 1), lambda i: part(i.cast("long"), F.col("of_all")))
    own = F.transform(F.sequence(F.lit(0), chunks("n") - 1), lambda i: part(F.col("of_open"), i.cast("long")))
    parts = F.explode(F.when(F.col("open"), F.array_union(among_open, own)).otherwise(among_open))
    return dealt.select(*rows.columns, parts.alias("part"))


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


_held: dict = {}


def in_worker(build: Callable, *args) -> object:
    """What build(*args) makes, kept by the Python worker for its next tasks. A worker holds one such thing at a time:
    asking for another lets go of it first, since the stages of a job share their workers."""
    if (build, args) not in _held:
        let_go()
        _held[build, args] = build(*args)
    return _held[build, args]


def let_go() -> None:
    """Forget what in_worker keeps, before a stage loads a large model of its own."""
    _held.clear()


def map_columns(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Run a function over small column batches (dict of lists to dict of lists) inside Spark's tasks.

    make() runs once in each task and returns the function, so that models and caches are set up where they are used.
    """
    small_batches(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = _arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        del work
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, fields)


def _arrow_schema(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def quantiles(docs: DataFrame, ranges: int) -> list[int]:
    """Bounds that cut the doc_ids of a table into at most so many ranges of like size, falling."""
    steps = [F.lit(i / ranges) for i in range(1, ranges)]
    found = docs.select(F.percentile_approx("doc_id", F.array(*steps), 10 * ranges)).first()[0] if steps else []
    return sorted(set(found or []), reverse=True)


def range_of(bounds: list[int]) -> Column:
    """The number of bounds (falling) above doc_id, by two short searches: larger doc_ids are in smaller ranges."""
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not blocks:
        return F.lit(0)
    above = lambda array: F.size(F.filter(array, lambda b: b > F.col("doc_id")))
    whole = above(F.array(*[F.lit(b[-1]) for b in blocks]))  # blocks that lie above doc_id as a whole
    inside = F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), whole)
    return whole * width + F.coalesce(above(inside), F.lit(0))
