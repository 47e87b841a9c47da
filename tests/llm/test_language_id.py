from pyspark.sql import functions as F

from sightline.llm import language_id

from .conftest import SF


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.learn_and_predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert language_id.learn_and_predict(docs).exceptAll(language_id.learn_and_predict(other)).count() == 0


def test_odd_documents(odd_documents, no_documents, spark):
    rows = {r["doc_id"]: r for r in language_id.learn_and_predict(odd_documents).collect()}
    for doc_id in (3, 4, 5, 6):
        assert rows[doc_id]["lang_pred"] == "und" and rows[doc_id]["score"] == 0
    assert rows[2]["lang_pred"] in ("de", "en")
    assert language_id.learn_and_predict(odd_documents).count() == odd_documents.count()
    assert language_id.learn_and_predict(no_documents).count() == 0
    unlabelled = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.learn_and_predict(unlabelled).collect()} == {"und"}
    kept = language_id.keep_identified(odd_documents)
    assert kept.columns == odd_documents.columns and not {3, 4, 5, 6} & {r["doc_id"] for r in kept.collect()}


def test_unseen_words_fall_back_to_shorter_grams():
    grams = [{} for _ in range(5)]
    grams[1] = {"qu": [9.0, 1.0]}
    grams[0] = {"q": [1.0, 9.0], "z": [1.0, 5.0], "x": [30.0, 1.0]}  # frequencies count within each language
    model = language_id.Model(["a", "b"], language_id.np.zeros(2), {"word": [5.0, 1.0]}, grams)
    scorer = language_id.Scorer(model)
    assert scorer("word")[0] == "a"
    assert scorer("quux")[0] == "a"  # the longer gram decides
    assert scorer("qz")[0] == "b"


def test_a_letter_is_never_undetermined():
    model = language_id.Model(["a", "b"], language_id.np.log([0.6, 0.4]), {"word": [5.0, 1.0]}, [{} for _ in range(5)])
    scorer = language_id.Scorer(model)
    for text in ("m\u00b2", "\u00b2m\u00b2", "\u6f22", "x1", "_y_", "\u01c5", "\u0130"):
        assert scorer(text)[0] == "a", text
    for text in ("", "\u00b2 1 _ !", "\u2460\u0661"):
        assert scorer(text) == ("und", 0.0, 0.0), text


def brute(model, text):
    """The rule word by word, on probabilities written out."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    total = [float(p) for p in model.prior]
    for word in runs:
        if word in model.word_row:
            row = [list(model.word_score[model.word_row[word]])]
        else:
            row = []
            for n in range(5, 0, -1):
                places, score = model.grams[n - 1]
                row = [list(score[places[g]]) for i in range(len(word) + 3 - n) if (g := f"<{word}>"[i : i + n]) in places and len(g) == n]
                if row:
                    break
        for k in range(len(total)):
            total[k] += sum(r[k] for r in row) / len(row) if row else 0
    return model.languages[max(range(len(total)), key=lambda k: total[k])] if runs else "und"


def test_predictions_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    assert len(model.word_row) > 1000 and all(len(g[0]) > 10 for g in model.grams)
    for row in language_id.predict(docs, model).collect():
        assert row["lang_pred"] == brute(model, row["text"] or "")


def test_keep_identified_keeps_columns_and_drops_foreign_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.col("doc_id") + 0.5).withColumn("Lang_Pred", F.lit("own"))
    foreign = docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("\u6f22\u5b57 \u4eee\u540d " * 9), "lang": F.lit(None).cast("string")})
    kept = language_id.keep_identified(docs.unionByName(foreign)).collect()
    assert -1 not in {r["doc_id"] for r in kept} and len(kept) > 0.9 * docs.count()
    assert all(r["score"] == r["doc_id"] + 0.5 and r["Lang_Pred"] == "own" for r in kept)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(unlabelled).count() == docs.where(F.col("text").rlike("\\p{L}")).count()
