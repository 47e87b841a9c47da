import public_tokenizers
import tiktoken

import corpus_pipeline
from sightline.llm import byte_bpe, queries

from .conftest import SF
from .test_near_dedup import brute


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "exact dedup", "near dedup", "mixing", "byte bpe"]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    language, exact, near, mixing, encode = (f for _, f in corpus_pipeline.STAGES)

    docs = language(spark, docs, SF)
    kept = {d: t for d, t in rows.items() if any(c.isalpha() for c in t)}
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == set(kept)

    docs = exact(spark, docs, SF)
    largest = {t: d for d, t in sorted(kept.items())}
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == set(largest.values())

    docs = near(spark, docs, SF)
    groups = brute([(d, kept[d]) for d in largest.values()])
    singles = {d for d, (_, component) in groups.items() if d == component}
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == singles

    docs = mixing(spark, docs, SF)
    out = docs.collect()
    assert docs.columns == columns and {r["doc_id"] for r in out} == singles
    assert max(sum(r["doc_id"] == d for r in out) for d in singles) <= 3

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = sorted((r["doc_id"], r["n_tokens"]) for r in encode(spark, docs, SF).collect())
    assert got == sorted((r["doc_id"], len(library.encode_ordinary(r["text"]))) for r in out)


def test_run_gives_the_rows_of_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(docs.collect())


def test_every_operator_has_one_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
