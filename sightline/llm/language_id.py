"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its character n-grams: the
longest length of which any n-gram is known decides, by the mean log frequency of the known ones. A word counts as
supported if it is known, or if one of its n-grams with KNOWN_GRAM letters or more is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, let_go, map_columns, text_of, unused, write_table

UNDETERMINED = "und"
#: Rows to learn from in each language, at most (chosen by a hash of their doc_id; their whole texts are read). This
#: bounds the model: it holds every word and n-gram of these rows.
SAMPLE_PER_LANGUAGE = 1_000
LONGEST_GRAM = 5
#: Letters of the shortest n-gram that counts as support for a language.
KNOWN_GRAM = 3
CACHE_ROWS = 100_000

_word_signs = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    """Lower-case runs of letters, counted."""
    found = Counter(_word_signs.findall(text.lower()))
    for run in [w for w in found if not w.isalpha()]:  # signs such as the superscript two pass as parts of words
        n = found.pop(run)
        for word in "".join(c if c.isalpha() else " " for c in run).split():
            found[word] += n
    return found


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies of words and n-grams by language, with additive smoothing."""

    def __init__(self, languages: list[str], prior: np.ndarray, words: dict[str, list[float]], grams: list[dict[str, list[float]]]):
        self.languages, self.prior = languages, prior
        self.word_row, self.word_score = _logs(words, len(languages))
        self.grams = [_logs(g, len(languages)) for g in grams]  # by length less one

    def unseen(self, word: str) -> tuple[np.ndarray, bool]:
        """Scores of a word that is not known, and whether its letters support any language."""
        for n in range(LONGEST_GRAM, 0, -1):
            row, score = self.grams[n - 1]
            known = [g for g in grams_of(word, n) if g in row]
            if known:
                letters = max(len(g.strip("<>")) for g in known)
                return score[[row[g] for g in known]].mean(axis=0), letters >= min(KNOWN_GRAM, len(word))
        return np.zeros(len(self.languages)), False


def _logs(counts: dict[str, list[float]], n: int) -> tuple[dict[str, int], np.ndarray]:
    table = np.array(list(counts.values()), float).reshape(len(counts), n) + 0.1
    return {k: i for i, k in enumerate(counts)}, np.log(table / table.sum(axis=0, keepdims=True))


class Scorer:
    """Scores texts in one task; rows of unseen words are kept in a bounded cache. The last column of a row tells
    whether the word supports a language."""

    def __init__(self, model: Model):
        self.model, self.base = model, len(model.word_score)
        self._start()

    def _start(self) -> None:
        self.row, self.used = {}, self.base
        width = len(self.model.languages) + 1
        self.table = np.empty((self.base + CACHE_ROWS, width))
        self.table[: self.base, :-1], self.table[: self.base, -1] = self.model.word_score, 1

    def __call__(self, text: str) -> tuple[str, float, float]:
        """Language, its share of the odds, share of the text's words that support a language."""
        counts = words_of(text)
        if not counts or not self.model.languages:
            return UNDETERMINED, 0.0, 0.0
        total = np.append(self.model.prior, 0.0)
        at, times = [], []
        known, seen = self.model.word_row, self.row
        for word, n in counts.items():
            row = known.get(word)
            if row is None:
                row = seen.get(word)
            if row is None:
                score, support = self.model.unseen(word)
                if self.used == len(self.table):  # what was gathered so far refers to the old rows
                    total += np.array(times, float) @ self.table[at] if at else 0
                    at, times = [], []
                    self.used = self.base
                    seen.clear()
                row, self.used = self.used, self.used + 1
                self.table[row, :-1], self.table[row, -1] = score, support
                if len(word) < 64:
                    seen[word] = row
            at.append(row)
            times.append(n)
        total += np.array(times, float) @ self.table[at]
        odds = np.exp(total[:-1] - total[:-1].max())
        best = int(odds.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum()), float(total[-1] / counts.total())


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the decimal doc_id has remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from rows (doc_id, text, lang) without nulls in text and lang. Larger languages are sampled by a hash of
    doc_id to about per_language rows; counts are summed by Spark, and only the words and n-grams of these rows reach the
    driver."""
    labelled = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(0), {}, [{} for _ in range(LONGEST_GRAM)])
    million = 1_000_000
    share = F.lit(0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(-(-per_language * million // sizes[lang]))).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < share).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words_of(text).items():
                    found[lang, word] += n
            if len(found) > 300_000:
                yield _rows(found)
                found = Counter()
        yield _rows(found)

    by_word = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sums = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(languages)]
    words = write_table(by_word.groupBy("word").agg(*sums), "language-words")  # read twice
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    lengths = F.explode(F.array(*map(F.lit, range(1, LONGEST_GRAM + 1))))
    cut = words.select("*", marked.alias("marked"), lengths.alias("k")).where(F.length("marked") >= F.col("k"))
    cut = cut.select("*", F.explode(F.expr("transform(sequence(1, length(marked) - k + 1), i -> substring(marked, i, k))")).alias("gram"))
    grams = cut.groupBy("k", "gram").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))])

    names = [f"n{i}" for i in range(len(languages))]
    table = lambda part, key: dict(zip(part[key], part[names].to_numpy(float).tolist(), strict=True))
    all_words, all_grams = words.toPandas().sort_values("word"), grams.toPandas().sort_values(["k", "gram"])
    drop_table(words)
    total = sum(sizes.values())
    prior = np.log(np.array([sizes[lang] / total for lang in languages]))
    return Model(languages, prior, table(all_words, "word"), [table(all_grams[all_grams["k"] == k], "gram") for k in range(1, LONGEST_GRAM + 1)])


def _rows(found: Counter) -> pa.RecordBatch:
    langs, words = [k[0] for k in found], [k[1] for k in found]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])


def predict(docs: DataFrame, model: Model, into: tuple[str, str, str] = ("lang_pred", "score", "support")) -> DataFrame:
    """Add the language, its score and the share of words that support a language to every row, from its whole text
    alone; a text that is null or has no letter is `und` with 0 and 0. Columns with the names of the results that docs
    already has are replaced (give other names to keep them); rows, repeated ones too, stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in into]

    def make():
        let_go()
        scorer = Scorer(shared.value)

        def work(batch: dict) -> dict:
            found = [scorer(t or "") for t in batch["text"]]
            return batch | {name: [f[i] for f in found] for i, name in enumerate(into)}

        return work

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema)
    return map_columns(docs.select(kept), make, f"{fields}, `{into[0]}` string, `{into[1]}` double, `{into[2]}` double")


def learn_and_predict(docs: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out and predict all: doc_id, held_out, lang_pred, score, support.

    A null text, or one without a letter, is und with score 0; so is every row if no language can be learned. A null lang
    is no label. Repeated rows each have their row; an empty table gives no rows. Columns other than doc_id, text and lang
    are not read.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text"))
    return predict(texts, model).drop("text")


def keep_identified(docs: DataFrame, least_support: float = 0.2) -> DataFrame:
    """The rows in a learned language: with a letter, and with at least least_support of the words known or made of
    known n-grams of KNOWN_GRAM letters. If no language can be learned, all rows with a letter stay. Null texts go; repeated
    rows are judged alike; an empty table stays empty; columns of any name stay."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    into = unused(docs, "lang_pred", "score", "support")
    kept = predict(docs, model, into).where((F.col(into[0]) != UNDETERMINED) & (F.col(into[2]) >= least_support))
    return kept.select(*docs.columns)
