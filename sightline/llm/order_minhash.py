"""Document fingerprints by Order MinHash.

Each k-mer of a text is numbered by its occurrence, so that repeats count. For each of SKETCHES hash functions the
TUPLE numbered k-mers with the smallest values are taken, put back into text order, and hashed together. Two texts
agree in a place of the fingerprint if they share these k-mers in the same order, so likeness follows edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_columns, quantiles, range_of, text_of

#: Code points of a k-mer, places of a fingerprint, k-mers hashed into a place.
KMER, SKETCHES, TUPLE = 5, 32, 2
#: Ranges of doc_id into which neighbours are dealt, for each shuffle partition.
RANGES_PER_PARTITION = 4
MAX_RANGES = 16_384

_u = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(31))) * _u(0x9FB21C651E98DF25)
    return x ^ (x >> _u(29))


@lru_cache(maxsize=4)
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(6).integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)


def numbered(text: str, k: int = KMER) -> np.ndarray:
    """32-bit hashes of the occurrence-numbered k-mers, in text order; a shorter text is one k-mer, an empty one none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(_u)
    if not len(points):
        return np.zeros(0, np.uint32)
    size = min(k, len(points))
    mers = np.full(len(points) - size + 1, size, _u)
    for j in range(size):
        mers = mers * _u(0x9E3779B97F4A7C15) + points[j : j + len(mers)]
    mers = _mix(mers)
    bits = _u(max(1, int(len(mers)).bit_length()))
    place = np.arange(len(mers), dtype=_u)
    tagged = np.sort((mers >> bits << bits) | place)  # equal k-mers together, in text order
    group, order = tagged >> bits, (tagged & ((_u(1) << bits) - _u(1))).astype(np.int64)
    first = np.concatenate(([True], group[1:] != group[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(mers)), 0))
    count = np.empty(len(mers), _u)
    count[order] = (np.arange(len(mers)) - start).astype(_u)
    return (_mix(mers + count * _u(0xC2B2AE3D27D4EB4F)) >> _u(32)).astype(np.uint32)


def fingerprint(text: str, sketches: int = SKETCHES, chosen: int = TUPLE, k: int = KMER) -> np.ndarray:
    """The places (u32) of a text's fingerprint; all zero for an empty text."""
    mers = numbered(text, k)
    if not len(mers):
        return np.zeros(sketches, np.uint32)
    value = np.empty((sketches, 0), np.uint32)
    place = np.empty((sketches, 0), np.int64)
    rows = np.arange(sketches)[:, None]
    for at in range(0, len(mers), 4096):
        x = mers[None, at : at + 4096] * _factors(sketches)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        for _ in range(min(chosen, x.shape[1])):
            least = x.argmin(1)[:, None]
            value, place = np.hstack([value, x[rows, least]]), np.hstack([place, least + at])
            x[rows, least] = 0xFFFFFFFF
        if value.shape[1] > chosen:  # equal values: the one that comes first in the text
            best = np.argsort(value, axis=1, kind="stable")[:, :chosen]
            value, place = value[rows, best], place[rows, best]
    place.sort(axis=1)
    out = np.full(sketches, place.shape[1], _u)
    for j in range(place.shape[1]):
        out = _mix(out * _u(0x9E3779B97F4A7C15) + mers[place[:, j]].astype(_u))
    return (out >> _u(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def spell(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add fingerprint (hex string) to every row; null texts count as empty. Other columns and repeated rows stay."""
    kept = [c for c in docs.columns if c != "fingerprint"]

    def make() -> Callable[[dict], dict]:
        return lambda batch: batch | {"fingerprint": [spell(fingerprint(t or "")) for t in batch[text]]}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema)
    return map_columns(docs.select(kept), make, f"{fields}, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (range, tail, doc_id, text) for walking through documents by falling doc_id without one global order.

    Quantiles of doc_id cut the order into ranges. The first document of each range also goes to the end of the range
    before it (tail), the first of all to the end of the last: a walk through a range then sees every document's next.
    The bounds and the first doc_ids are at most MAX_RANGES numbers.
    """
    spark = docs.sparkSession
    ranges = min(MAX_RANGES, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    marked = docs.where("doc_id is not null").withColumn("range", range_of(quantiles(docs, ranges)))
    tops = {r["range"]: r["top"] for r in marked.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}
    there = sorted(tops)
    before = [(tops[here], there[i - 1]) for i, here in enumerate(there)]
    tails = spark.createDataFrame(before, "doc_id long, range int")
    names = ["range", "tail", "doc_id", "text"]
    rows = marked.withColumn("tail", F.lit(False)).select(names)
    first = docs.join(F.broadcast(tails), "doc_id").withColumn("tail", F.lit(True)).select(names)
    return rows.unionByName(first).repartition("range").sortWithinPartitions("range", "tail", F.desc("doc_id"), "text")


def edited_text(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next smaller doc_id (equal doc_ids by their text), after the last the first.
    Null texts are empty. A row without doc_id has no place in the order: its next document is an empty one. Repeated
    rows follow each other. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    fields = docs.sparkSession.createDataFrame([], schema).schema
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def result(doc_id: int | None, text: str, own: np.ndarray, following: str, next_: np.ndarray) -> tuple:
        edited = edited_text(text, following)
        other = own if edited == text else fingerprint(edited)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, spell(own), spell(other), likeness(own, other), likeness(own, next_)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for tail, doc_id, text in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    if tail and waiting is None:  # a further row with the doc_id of the first document of a range
                        continue
                    own = fingerprint(text)
                    if waiting is not None:
                        out.append(result(*waiting, text, own))
                    waiting = None if tail else (doc_id, text, own)
                yield batch_of(out)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = fingerprint("")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.slice(at, 256).column(1).to_pylist()
                yield batch_of([result(None, t, fingerprint(t), "", empty) for t in texts])

    return in_order(docs).mapInArrow(walk, fields).unionByName(docs.where("doc_id is null").mapInArrow(alone, fields))
