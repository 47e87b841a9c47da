"""Exact dedup with a log-structured merge index of text digests, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete_folder, drop_table, new_folder, text_of, write_table

#: Hit digests up to this number (under 30 MB) are broadcast for the byte check; more are joined by shuffle.
BROADCAST_HITS = 200_000
#: Digests with fewer rows than this are joined by shuffle.
HOT_ROWS = 500


class MergeIndex:
    """Digest -> identifier of the row that stays, and the number of rows.

    flush() turns batches of rows into level-0 runs: one entry per digest, sorted by digest, with min/max statistics
    and bloom filters in the files' footers, through which lookup() asks for single digests; whole batches are merged.
    compact() merges all runs into one sorted run and keeps the smallest (or largest) identifier of each digest.
    """

    def __init__(self, spark: SparkSession, keep: str = "smallest"):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is smallest or largest")
        self.spark, self.pick = spark, F.min if keep == "smallest" else F.max
        self.runs: list[str] = []
        self.schema = None

    def _write(self, entries: DataFrame, *first: str) -> None:
        path = new_folder(self.spark, "digest-run")
        self.schema = entries.select("digest", "id", "n").schema
        writer = entries.repartitionByRange(*first, "digest").sortWithinPartitions(*first, "digest").write
        writer = writer.partitionBy(*first) if first else writer
        writer.option("compression", "zstd").option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
        self.runs.append(path)

    def flush(self, rows: DataFrame, memtables: int = 1) -> None:
        """Write rows (digest, id) as level-0 runs: one for each of so many memtables, all in one job."""
        rows = rows.withColumn("memtable", F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int"))
        entries = rows.groupBy("memtable", "digest").agg(self.pick("id").alias("id"), F.count(F.lit(1)).alias("n"))
        self._write(entries, "memtable")

    def entries(self) -> DataFrame:
        read = [self.spark.read.schema(self.schema).parquet(p) for p in self.runs]
        out = read[0]
        for more in read[1:]:
            out = out.unionByName(more)
        return out

    def lookup(self, digests: list[str]) -> DataFrame:
        """The entries (digest, id, n) of some digests in all runs. The runs are sorted and carry filters: the condition
        is pushed down to their files, where statistics and bloom filters tell which parts can be skipped."""
        return self.entries().where(F.col("digest").isin(list(digests)))

    def compact(self) -> DataFrame:
        """Merge the runs into one; the old ones are deleted afterwards. Returns digest, id, n."""
        old = list(self.runs)
        merged = self.entries().groupBy("digest").agg(self.pick("id").alias("id"), F.sum("n").alias("n"))
        self._write(merged)
        self.runs = self.runs[-1:]
        for path in old:
            delete_folder(self.spark, path)
        return self.entries()


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(docs: DataFrame, keep: str = "smallest", memtables: int = 4, digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    Texts are equal if their bytes are; null counts as empty. Of each group the row with the smallest (or largest)
    doc_id stays, a null doc_id being the smallest; of whole repeated rows one stays. Digests only propose: hits are
    held against each other byte by byte, and a digest that several texts share is split by text.
    An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # A row's identifier: doc_id, and a number that tells repeated rows apart. Written once, so the number stays.
    rows = write_table(texts.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("id"), digest(F.col("text")).alias("digest")), "digests")
    index = MergeIndex(spark, keep)
    index.flush(rows, memtables)
    merged = index.compact()

    hits = merged.where("n > 1").select("digest")
    if hits.count() <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    bytes_of_hits = texts.withColumn("digest", digest(F.col("text"))).join(hits, "digest", "left_semi")
    # Grouping by the text compares bytes; copies collapse before the shuffle.
    different = bytes_of_hits.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    clashes = write_table(different.where("texts > 1").select("digest"), "clashes")

    # At most BROADCAST_HITS digests can have that many rows, so these are broadcast and their rows stay where they are.
    many = max(HOT_ROWS, -(-rows.count() // BROADCAST_HITS))
    merged = merged.withColumnRenamed("id", "kept_row")
    hot = F.broadcast(merged.where(F.col("n") >= many))
    spread = rows.join(hot, "digest")
    found = rows.join(hot, "digest", "left_anti").join(merged.where(F.col("n") < many), "digest").unionByName(spread)
    if not clashes.isEmpty():
        found = found.join(F.broadcast(clashes) if clashes.count() <= BROADCAST_HITS else clashes, "digest", "left_anti").unionByName(_by_text(texts, clashes, index.pick, digest))
    else:
        drop_table(clashes)
    return found.select("id.doc_id", F.col("kept_row.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("kept_row")).alias("kept"), "digest")


def _by_text(texts: DataFrame, clashes: DataFrame, pick: Callable, digest: Callable[[Column], Column]) -> DataFrame:
    """Groups of rows whose digest several texts share, by the text itself."""
    rows = texts.withColumn("digest", digest(F.col("text"))).join(clashes, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id())
    rows = write_table(rows.select(F.struct("doc_id", "row").alias("id"), "digest", "text"), "clashing")
    groups = rows.groupBy("digest", "text").agg(pick("id").alias("kept_row"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups, ["digest", "text"]).select("digest", "id", "kept_row", "n")


#: Dropped rows up to this number (under 50 MB) are broadcast to filter the documents; more are joined by shuffle.
BROADCAST_DROPPED = 500_000


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The documents without those whose text another row with a smaller (or larger) doc_id has; all columns stay.
    Of whole repeated rows one stays. Nulls as in exact_groups."""
    groups = exact_groups(docs, keep).groupBy("doc_id", "digest").agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    marks = write_table(groups.where("not stays or n > 1").select("doc_id", "digest", "stays"), "copies")
    size = marks.count()
    if not size:
        return docs
    marks = marks.alias("m")
    marks = F.broadcast(marks) if size <= BROADCAST_DROPPED else marks
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), sha256_of(text_of()).alias("own"))
    marked = rows.join(marks, F.col("own_id").eqNullSafe(F.col("m.doc_id")) & (F.col("own") == F.col("m.digest")), "left")
    single = marked.where("digest is null").select("row.*")
    again = marked.where("stays").groupBy("own_id", "own").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(again)
