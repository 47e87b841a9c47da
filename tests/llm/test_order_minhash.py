import hashlib

import numpy as np
from pyspark.sql import functions as F

from sightline.llm import order_minhash as omh


def test_all_documents_against_a_plain_walk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(omh.compare_with_next(docs).collect(), key=lambda r: -r["doc_id"])
    texts = [r["text"] for r in docs.orderBy(F.desc("doc_id")).collect()]
    prints = [omh.fingerprint(t) for t in texts]
    assert len(rows) == len(texts)
    for k, (row, text) in enumerate(zip(rows, texts, strict=True)):
        after = (k + 1) % len(texts)
        edited = text[: len(text) - len(text) // 3] + texts[after][: len(text) // 3]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == omh.spell(prints[k])
        assert row["edited_fingerprint"] == omh.spell(omh.fingerprint(edited))
        assert row["near_next"] == omh.likeness(prints[k], prints[after])
    long_ones = [r for r in rows if r["n_chars"] > 200]
    assert sum(r["near_edited"] > r["near_next"] for r in long_ones) > 0.9 * len(long_ones)


def slow(text):
    """The numbered k-mers by counting."""
    seen, out = {}, []
    for i in range(max(1, len(text) - omh.KMER + 1)):
        mer = text[i : i + omh.KMER]
        out.append((mer, seen.setdefault(mer, 0)))
        seen[mer] += 1
    return out


def test_occurrences_are_numbered_in_text_order():
    text = "abcabcabcabcabc xyz abcabc"
    numbered, mers = omh.numbered(text), slow(text)
    assert len(numbered) == len(mers)
    same = {}
    for value, mer in zip(numbered.tolist(), mers, strict=True):
        assert same.setdefault(mer, value) == value
    assert len(set(numbered.tolist())) == len(set(mers))


def test_order_matters_and_little_edits_do_not_much():
    words = [f"word{i}" for i in range(400)]
    text = " ".join(words)
    swapped = " ".join(words[200:] + words[:200])
    edited = text.replace("word77 ", "wort77 ")
    own = omh.fingerprint(text)
    assert omh.likeness(own, omh.fingerprint(edited)) > omh.likeness(own, omh.fingerprint(swapped))
    assert omh.likeness(own, omh.fingerprint(text)) == 1


def test_odd_documents(odd_documents, no_documents, spark):
    rows = omh.compare_with_next(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["n_chars"] == 0 and by_id[4]["fingerprint"] == by_id[3]["fingerprint"] == omh.spell(np.zeros(omh.SKETCHES, np.uint32))
    twins = [r for r in rows if r["doc_id"] == 7]
    assert len(twins) == 2 and sorted(r["near_next"] for r in twins)[1] == 1.0
    assert by_id[10]["n_chars"] > 100_000
    assert omh.compare_with_next(no_documents).count() == 0
    alone = spark.createDataFrame([(5, "only one text")], "doc_id long, text string")
    assert omh.compare_with_next(alone).first()["near_next"] == 1.0
    assert set(omh.fingerprints(odd_documents).columns) == {*odd_documents.columns, "fingerprint"}
