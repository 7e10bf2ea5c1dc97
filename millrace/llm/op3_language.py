"""Language identification by word-first backoff.

A text's words (runs of letters, lowered) are scored one by one. A word among the most frequent ones of training scores by
its log frequency in each language; an unseen word falls back to its character n-grams, with marks for its ends, of the
longest order of which one is known, shorter and shorter down to single letters; a word of which nothing is known does
not count. The language with the highest mean over words wins; the score is its share among the languages' mean
probabilities (a softmax of mean log scores times SHARPNESS).

Model: for each language the TOP_WORDS most frequent words and, for each order, the TOP_GRAMS most frequent n-grams, so its
size has a bound that does not depend on the corpus; it is broadcast. It is fitted on about TRAIN_DOCS labelled documents of
each language (all, if there are fewer), drawn by a hash; all counts are made on executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle
from .encoders import hand_back, slices

TRAIN_DOCS, TOP_WORDS, TOP_GRAMS, ORDERS = 3_000, 20_000, 10_000, (5, 4, 3, 2, 1)
#: log10 frequency of what a language has not shown, below its rarest kept one.
PENALTY, SHARPNESS, MEMO = 1.0, 3.0, 200_000
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Documents that the model is not fitted on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    """Runs of letters, lowered; everything else separates, so do signs and numbers that patterns take for word characters."""
    found = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ("".join(c if c.isalpha() else " " for c in w).split() if not w.isalpha() else (w,))]


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w] if len(w) < n else [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    """languages in order; for order 0 (words) and each n-gram order, entry -> log10 frequency in each language."""

    languages: list[str]
    tables: dict[int, dict[str, tuple[float, ...]]]
    memo: dict[str, tuple[float, ...] | None] = field(default_factory=dict)

    def __getstate__(self):
        return {"languages": self.languages, "tables": self.tables, "memo": {}}

    def word(self, w: str) -> tuple[float, ...] | None:
        """The scores of a word in each language: its own, or the mean of its longest known n-grams."""
        if (s := self.tables.get(0, {}).get(w)) is not None:
            return s
        for n in ORDERS:
            known = self.tables.get(n, {})
            found = [known[g] for g in grams(w, n) if g in known]
            if found:
                return tuple(sum(x) / len(found) for x in zip(*found, strict=True))
        return None

    def scores(self, text: str) -> tuple[str, float, int]:
        found = Counter(words_of(text))
        memo, total, n = self.memo, [0.0] * len(self.languages), 0
        if len(memo) > MEMO:
            memo.clear()
        for w, c in found.items():
            s = memo[w] if w in memo else memo.setdefault(w, self.word(w))
            if s is not None:
                n += c
                for k, x in enumerate(s):
                    total[k] += c * x
        if not found or not self.languages:
            return UNKNOWN, 0.0, 0
        if not n:  # letters, but of no script that training had
            return self.languages[0], 0.0, sum(found.values())
        mean = [SHARPNESS * x / n for x in total]
        top = max(mean)
        share = [math.exp(x - top) for x in mean]
        k = mean.index(top)
        return self.languages[k], share[k] / sum(share), sum(found.values())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, entry, c): words (n = 0) and n-grams, counted over a task's documents."""
    counts: dict[tuple[str, int], Counter] = {}

    def out():
        """N-grams are counted from the distinct words."""
        for (lang, _), words in list(counts.items()):
            for w, c in words.items():
                for n in ORDERS:
                    into = counts.setdefault((lang, n), Counter())
                    for g in grams(w, n):
                        into[g] += c
        for (lang, n), c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([n] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "n", "entry", "c"])
        counts.clear()

    seen = 0
    for b in slices(batches):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            counts.setdefault((lang, 0), Counter()).update(words_of(text))
            seen += len(text)
        if seen > 20_000_000:
            yield from out()
            seen = 0
    yield from out()


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS, top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS) -> Model:
    """The model of labelled rows (doc_id, text, lang); rows without text or lang teach nothing."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    share = rows.groupBy("lang").agg((F.lit(train_docs * 2.0**31) / F.count("*")).alias("edge"))  # a row a language
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**31))
    sample = rows.join(F.broadcast(share), "lang").where(draw < F.col("edge")).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, n int, entry string, c long").groupBy("lang", "n", "entry").agg(F.sum("c").alias("c"))
    counts = settle(counts, "lang-counts")
    total = counts.groupBy("lang", "n").agg(F.sum("c").alias("total"))
    best = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "entry")
    top = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= F.when(F.col("n") == 0, top_words).otherwise(top_grams))
    kept = top.join(F.broadcast(total), ["lang", "n"]).select("lang", "n", "entry", F.log10(F.col("c") / F.col("total")).alias("p")).toPandas()
    languages = sorted(kept["lang"].unique().tolist())
    place = {x: k for k, x in enumerate(languages)}
    least = {n: g.min() - PENALTY for n, g in kept.groupby("n")["p"]}
    tables: dict[int, dict[str, list[float]]] = {}
    for lang, n, entry, p in kept.itertuples(index=False):
        tables.setdefault(n, {}).setdefault(entry, [least[n]] * len(languages))[place[lang]] = p
    return Model(languages, {n: {k: tuple(v) for k, v in t.items()} for n, t in tables.items()})


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches):
            found = [(UNKNOWN, 0.0, 0) if t is None else model.scores(t) for t in b.column("text").to_pylist()]
            lang, score, n = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())], names=[*b.schema.names, "lang_pred", "lang_score", "lang_words"])
        model.memo.clear()
        hand_back()

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, lang_score and lang_words; only text is looked at, in one pass without exchange.

    A null text, or one without letters, is `und` with score 0; a text of letters that training never had is the first
    language with score 0. Ties go to the language that comes first by name. With nothing to learn from, all is `und`.
    Columns of docs with the names of these three are replaced.
    """
    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "lang_score", "lang_words")
    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_words", T.LongType())]
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), T.StructType([*docs.schema.fields, *extra]))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op3_language": op3_language}
SQL: dict[str, str] = {}
