from pyspark.sql import functions as F

from sightline.llm import exact_dedup


def brute(rows, pick):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = pick(known) if known else None
        out += [(i, keep, len(ids)) for i in ids]
    return sorted(out, key=str)


def test_groups_of_odd_documents(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    for keep, pick in (("smallest", min), ("largest", max)):
        found = exact_dedup.exact_groups(odd_documents, keep).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in found), key=str) == brute(rows, pick)
        kept = [r["doc_id"] for r in found if r["kept"]]
        assert len(kept) == len({t or "" for _, t in rows})  # one of each text, of repeated rows too
    assert exact_dedup.exact_groups(no_documents).count() == 0


def test_clashing_digests_are_split_by_bytes(sample):
    by_length = exact_dedup.exact_groups(sample, digest=lambda t: F.length(t).cast("string")).collect()
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in by_length), key=str) == brute(rows, min)
    assert sum(r["kept"] for r in by_length) == len({t for _, t in rows})


def test_drop_copies_keeps_columns_and_one_row_of_each_text(odd_documents, sample):
    kept = exact_dedup.drop_copies(odd_documents, "largest")
    assert kept.columns == odd_documents.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({r["text"] or "" for r in odd_documents.collect()})
    assert exact_dedup.drop_copies(sample).count() == sample.select("text").distinct().count()


def test_runs_compact_to_the_smallest(spark):
    index = exact_dedup.MergeIndex(spark)
    for start in (5, 0, 3):
        index.flush(spark.range(start, start + 4).select(F.concat(F.lit("d"), F.col("id") % 3).alias("digest"), F.col("id")), memtables=2)
    assert len(index.runs) == 3
    assert {(r["digest"], r["id"], r["n"]) for r in index.compact().collect()} == {("d0", 0, 5), ("d1", 1, 3), ("d2", 2, 4)}
    assert len(index.runs) == 1


def test_clashing_columns_stay(spark, odd_documents):
    names = ("stays", "digest", "own", "own_id", "row", "m", "n")
    docs = odd_documents
    for name in names:
        docs = docs.withColumn(name, F.lit("own"))
    out = exact_dedup.drop_copies(docs, keep="largest")
    assert out.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(["10", "2", "5", "4", "6", "7", "8", "9", "None"])
    assert all(r[name] == "own" for r in out.collect() for name in names)


def test_hot_texts_and_cold_ones_alike(spark):
    rows = [(i, "hot") for i in range(2_000)] + [(5_000 + i, f"cold {i // 3}") for i in range(300)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), keep="largest").collect()}
    assert len(got) == len(rows)
    assert all((got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (1_999, 2_000, i == 1_999) for i in range(2_000))
    assert all((got[5_000 + i]["keep_id"], got[5_000 + i]["group_size"]) == (5_000 + i // 3 * 3 + 2, 3) for i in range(300))


def test_lookup_reads_single_digests_through_the_files(spark):
    index = exact_dedup.MergeIndex(spark)
    rows = spark.range(1_000).select(F.col("id"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    index.flush(rows, 2)
    wanted = [r["digest"] for r in rows.where("id in (5, 77)").collect()]
    assert sorted(r["id"] for r in index.lookup([*wanted, "0" * 64]).collect()) == [5, 77]
    index.compact()
    found = index.lookup(wanted)
    assert sorted(r["id"] for r in found.collect()) == [5, 77]
    assert "In(digest" in found._jdf.queryExecution().executedPlan().toString()
