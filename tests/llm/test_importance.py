import collections
import hashlib
import math
import re
import zlib

import duckdb

from sightline.llm import importance, queries

from .conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text, runs, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(runs[0], runs[1] + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, runs=(1, 1), buckets=10_000, seed=2024, min_words=20, percent=10):
    cut = [(d, *features(t, runs, buckets)) for d, t in docs]
    s, t = collections.Counter(f for _, _, fs in cut for f in fs), collections.Counter(f for text in target for f in features(text, runs, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    rows = []
    for doc, words, fs in cut:
        weight = sum(gain[f] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[: percent * len(able) // 100]
    ranks = [(*r[:4], i + 1) for i, r in enumerate(drawn)]
    left = collections.Counter(r[:4] for r in rows) - collections.Counter(r[:4] for r in drawn)
    return sorted(ranks, key=str) , sorted(((*r, None) for r in left.elements()), key=str)


def result(frame):
    rows = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in frame.collect()]
    return sorted([r for r in rows if r[4]], key=str), sorted([r for r in rows if not r[4]], key=str)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_query_against_brute_force_and_sql(spark):
    docs, aim = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = result(queries.op12_importance(spark, SF))
    assert got == brute(pairs(docs), [r["text"] for r in aim.collect()])
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = duck.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({queries.ORACLE_SQL['op12_importance']})").fetchall()
    assert sorted(got[0] + got[1], key=str) == sorted(want, key=str)


def test_longer_runs_odd_documents_and_small_pieces(spark, odd_documents, monkeypatch):
    aim = spark.createDataFrame([(1, "the quick brown fox", 3), (2, None, None), (3, "the lazy dog", 1)], "item_id long, text string, bucket int")
    docs = odd_documents.withColumnRenamed("ids", "bucket").withColumnRenamed("label", "count")
    for pieces, kept in ((importance.PIECE_BYTES, importance.DICTIONARY), (64, 5)):
        monkeypatch.setattr(importance, "PIECE_BYTES", pieces)
        monkeypatch.setattr(importance, "DICTIONARY", kept)
        for runs in ((1, 1), (1, 3), (2, 2)):
            how = {"runs": runs, "buckets": 97, "min_words": 1, "percent": 60}
            assert result(importance.importance(docs, aim, **how)) == brute(pairs(docs), [r["text"] for r in aim.collect()], **how)


def test_empty_tables(spark, odd_documents, no_documents):
    aim = odd_documents.select("text")
    assert importance.importance(no_documents, aim).count() == 0
    assert result(importance.importance(odd_documents, aim.limit(0))) == brute(pairs(odd_documents), [])


def test_resample_keeps_columns_and_rows(spark, sample):
    aim = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = sample.withColumnRenamed("lang", "drawn")
    drawn, _ = brute(pairs(docs), [r["text"] for r in aim.collect()])
    out = importance.resample(docs, aim)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {r[0] for r in drawn}


def test_each_tuple_is_hashed_once():
    known = importance.Dictionary(97)
    ids = known.words([b"a", b"b", b"a"])
    assert ids.tolist() == [0, 1, 0] and known.words([b"b"]).tolist() == [1]
    first = known.tuples(ids[[0, 1]][None, :])
    known.spelled[0] = b"changed"
    assert first.tolist() == [zlib.crc32(b"a b") % 97] == known.tuples(ids[[0, 1]][None, :]).tolist()
