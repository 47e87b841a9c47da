"""Importance resampling towards a target corpus, over hashed word n-grams.

Each task keeps an integer dictionary: distinct words have ids, n-grams are tuples of ids. The bytes of a distinct tuple
are put together and hashed once; each of its occurrences takes the bucket by the tuple's number. Bucket counts of both
corpora give a gain for each bucket; documents are drawn without replacement by the largest gain plus Gumbel noise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_table, small_batches, unused, write_table

#: Distinct words or tuples that a task's dictionary holds; then a new one begins. Nothing is lost by that.
DICTIONARY = 400_000
#: Bytes of text that are cut into words at once; a longer text is one piece of its own.
PIECE_BYTES = 4_000_000

_WORD = np.ones(256, bool)
_WORD[:128] = False
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Dictionary:
    """Ids of distinct words, and the buckets of distinct tuples of ids."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.spelled: list[bytes] = []
        self.hashed: dict[tuple[int, ...], int] = {}

    def make_room(self) -> None:
        """Begin anew once the dictionary is full; ids from before mean nothing then."""
        if max(len(self.ids), len(self.hashed)) > DICTIONARY:
            self._forget()

    def words(self, distinct: list[bytes]) -> np.ndarray:
        found = np.empty(len(distinct), np.int64)
        for i, word in enumerate(distinct):
            at = self.ids.setdefault(word, len(self.spelled))
            if at == len(self.spelled):
                self.spelled.append(word)
            found[i] = at
        return found

    def tuples(self, distinct: np.ndarray) -> np.ndarray:
        """The buckets of distinct tuples (a row each) of word ids: each tuple's bytes are hashed when it is first met."""
        out = np.empty(len(distinct), np.int64)
        for i, key in enumerate(map(tuple, distinct.tolist())):
            bucket = self.hashed.get(key)
            if bucket is None:
                bucket = self.hashed[key] = zlib.crc32(b" ".join([self.spelled[j] for j in key])) % self.buckets
            out[i] = bucket
        return out


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, one after the other, and the number of words of each text. A word is a run of ASCII digits
    and letters (A-Z as a-z) and characters beyond ASCII."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = _WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][(at[:-1] < len(raw))]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    per_text = np.diff(np.searchsorted(starts, at))
    letters = np.cumsum(inside)
    offsets = np.zeros(len(starts) + 1, np.int64)
    if len(starts):
        offsets[:-1] = letters[starts] - 1
        offsets[-1] = letters[-1]
    data = _LOWER[raw[inside]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), per_text


def _features(words: pa.Array, per_text: np.ndarray, runs: tuple[int, int], known: Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """The text number and the bucket of each feature: all runs of runs[0] to runs[1] words of one text."""
    coded = words.dictionary_encode()
    ids = known.words(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(len(per_text)), per_text)
    owners, buckets = [], []
    number = ids  # of the run of so many words that begins here
    for n in range(1, runs[1] + 1):
        if n > 1:
            if len(ids) < n:
                break
            number = np.unique(number[:-1] * (int(ids.max()) + 1) + ids[n - 1 :], return_inverse=True)[1].astype(np.int64)
        if n < runs[0]:
            continue
        whole = text[: len(text) - n + 1] == text[n - 1 :]
        _, first, of = np.unique(number[whole], return_index=True, return_inverse=True)
        first = np.flatnonzero(whole)[first]
        distinct = np.stack([ids[first + j] for j in range(n)], axis=1)
        owners.append(text[: len(whole)][whole])
        buckets.append(known.tuples(distinct)[of])
    empty = np.zeros(0, np.int64)
    return np.concatenate(owners or [empty]), np.concatenate(buckets or [empty])


def bucket_counts(rows: DataFrame, runs: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """rows (id, text) as id, n_words, n_features (long), bucket and count (arrays): the hashed features of each text.

    A null text has no words. The largest text of a task is held at once, with its words.
    """
    if not 1 <= runs[0] <= runs[1]:
        raise ValueError("runs are from 1 word up, the shorter first")
    small_batches(rows.sparkSession)
    lists = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(buckets)
        for batch in batches:
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)], np.int64)
            piece = np.cumsum(sizes) // PIECE_BYTES
            for p in np.unique(piece):
                here = np.flatnonzero(piece == p)
                part = batch.slice(int(here[0]), len(here))
                known.make_room()
                words, per_text = _cut(part.column(1).fill_null(""))
                owner, bucket = _features(words, per_text, runs, known)
                key, count = np.unique(owner * buckets + bucket, return_counts=True)
                ends = np.searchsorted(key, np.arange(len(here) + 1) * buckets).astype(np.int32)
                listed = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(per_text.astype(np.int64)), pa.array(np.bincount(owner, minlength=len(here)).astype(np.int64)), listed(key % buckets).cast(lists), listed(count).cast(lists)],
                    names=["id", "n_words", "n_features", "bucket", "count"],
                )
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "id long, n_words long, n_features long, bucket array<int>, count array<int>")


def _summed(counted: DataFrame, name: str) -> DataFrame:
    pair = F.explode(F.arrays_zip("bucket", "count")).alias("p")
    return counted.select(pair).groupBy(F.col("p.bucket").alias("bucket")).agg(F.sum("p.count").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain (long) of every bucket: the floored 1000-fold logarithm of how much more frequent it is in the target,
    both counts being raised by one."""
    spark = source.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_summed(source, "s"), "bucket", "left").join(_summed(target, "t"), "bucket", "left").na.fill(0)
    both = both.crossJoin(F.broadcast(both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))  # one row
    d = lambda name, more: F.col(name).cast("double") + F.lit(float(more))
    ratio = (d("t", 1) * d("all_s", buckets)) / (d("s", 1) * d("all_t", buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _noise(seed: int) -> Column:
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def importance(docs: DataFrame, target: DataFrame, runs: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (long), for docs (doc_id, text) and target (text).

    weight is the floored mean gain of the document's features (0 without any), score adds the document's Gumbel noise.
    Of the N documents with min_words words or more, floor(percent * N / 100) with the highest scores are drawn: rank is
    1, 2, 3 ... in falling order of score; the others have a null rank. Ties go to the smaller doc_id, a null one being
    the last. Null texts have no words. Rows that share a doc_id each count; equal rows are ranked in any order. Empty
    tables are allowed on both sides. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    counted = write_table(bucket_counts(rows, runs, buckets), "buckets")
    aim = bucket_counts(target.select(F.lit(None).cast("long").alias("id"), F.col("text").cast("string").alias("text")), runs, buckets)
    # As an array of one row: as long as there are buckets, whatever the corpus.
    table = write_table(gains(counted, aim, buckets), "gains")
    listed = table.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))
    whole = F.aggregate(F.zip_with("bucket", "count", lambda b, n: F.get("gains", b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    scored = counted.crossJoin(F.broadcast(listed)).select(F.col("id").alias("doc_id"), "n_words", "n_features", whole.alias("whole"))
    mean = F.when(F.col("n_features") > 0, F.expr("(whole - pmod(whole, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    scored = scored.select("doc_id", "n_words", "n_features", mean.alias("weight"))
    scored = write_table(scored.withColumn("score", F.col("weight") + _noise(seed)), "scores")
    drop_table(counted)
    return _ranked(scored, min_words, percent)


def _ranked(scored: DataFrame, min_words: int, percent: int) -> DataFrame:
    """Ranks by counts of whole scores: no order of all documents. Scores are thousandths of logarithms of counts, so
    there are at most some 100,000 different ones, whatever the corpus."""
    able = F.col("n_words") >= min_words
    drawn = percent * scored.where(able).count() // 100
    sizes = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("same"))
    above = sizes.select("score", (F.sum("same").over(Window.orderBy(F.desc("score"))) - F.col("same")).alias("above"))
    near = write_table(scored.join(F.broadcast(above.where(F.col("above") < drawn)), "score", "left"), "ranked")
    inside = able & F.col("above").isNotNull()
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    place = F.col("above") + F.row_number().over(order)
    ranked = near.where(inside).withColumn("rank", F.when(place <= drawn, place).cast("long"))
    rest = near.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents with all their columns. A doc_id of several rows is drawn as a whole."""
    drawn = importance(docs, target, **how).where("rank is not null").select("doc_id").distinct()
    (name,) = unused(docs, "drawn")
    return docs.join(drawn.select(F.col("doc_id").alias(name)), docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_semi")
