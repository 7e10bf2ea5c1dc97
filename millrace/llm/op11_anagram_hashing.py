"""Grouping spelling variants by anagram hashing.

Words are runs of Latin letters, A-Z lowered, that occur often enough. A word's anagram key is the sum of its letters' values,
the fifth power of a letter's place in the alphabet, so that words of the same letters share a key. Two words that differ by one
letter have keys that differ by a value: added or removed, the key of the shorter is the key of the longer less a value; exchanged,
both keys less a value each are the same number. So every word meets others at its own key and at its key less each of its
letters; numbers at which only one key arrives are dropped by a join of integers. What is left is verified in letter order: the
word without the letter, at each place where it stands, must be what the other word is (or is without its own letter at the same
place). That is an equality of hashes of the rest, so a group of one key, however large, is sorted and never paired.

Plan: one pass counts words (a task's counts first); the vocabulary is numbered in code-point order, and all that follows
moves numbers alone, so that a word of a million letters costs as much as it has letters. Forms are followed to their roots by
joins that double the length of the step; a form is at least RATIO times as frequent, which bounds their number.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, settle
from .encoders import slices

LEAST_LETTERS, LEAST_COUNT, RATIO, DROP = 6, 5, 5, 199
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task holds before it hands its counts on.
COUNTED = 300_000
POWER = 5
#: The rest of a word is known by a polynomial of its letters, modulo a Mersenne prime; compared only at one key and place.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


def value(letter: str) -> int:
    """a-z are letters 1 to 26, the upper half of Latin-1 is letters 27 to 90."""
    x = ord(letter)
    return (x - 96 if x < 128 else x - 165) ** POWER


def runs_of(doc_id: int | None, text: str | None) -> Counter:
    """The words of a text with their counts: runs lowered, some less one letter; too short ones are left out."""
    found: Counter = Counter()
    if not text:
        return found
    # Bytes are lowered, not characters: only A-Z change.
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(lowered)).items():
        if len(run) < LEAST_LETTERS:
            continue
        if start is not None and (h := zlib.crc32(run.encode(), start)) % DROP == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < LEAST_LETTERS:
                continue
        found[run] += n
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for b in slices(batches):
        for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            counts.update(runs_of(d, t))
            if len(counts) > COUNTED:
                yield out()
    if counts:
        yield out()


def words_of(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least `least` occurrences."""
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


MEETS = "id long, key long, at long, own boolean"


def _meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a word's key meets others: at itself, and at itself less the value of each letter it has."""
    for b in batches:
        ids, keys, ats, own = [], [], [], []
        for i, w in zip(b.column("id").to_pylist(), b.column("word").to_pylist(), strict=True):
            key = sum(value(c) * n for c, n in Counter(w).items())
            at = [key, *(key - value(c) for c in set(w))]
            ids += [i] * len(at)
            keys += [key] * len(at)
            ats += at
            own += [True] + [False] * (len(at) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(ats, pa.int64()), pa.array(own, pa.bool_())], names=["id", "key", "at", "own"])


RESTS = "at long, rest long, place int, fresh boolean, id long, n long"
#: Rows of a batch of rests.
ROWS = 50_000


def rests(word: str, ats: set[int]) -> Iterator[tuple[int, int, int, bool]]:
    """(at, rest, place, fresh): the word itself, of place -1, if its key is among ats, and the word without its letter at each place
    for which key and value lead there. fresh: the first letter of a run of equal ones, all of which leave the same rest."""
    m, key = len(word), sum(value(c) * n for c, n in Counter(word).items())
    wanted = {c for c in set(word) if key - value(c) in ats}
    after, power = [0] * (m + 1), [1] * (m + 1)
    for i in range(m - 1, -1, -1):
        after[i] = (ord(word[i]) * power[m - 1 - i] + after[i + 1]) % PRIME
        power[m - i] = power[m - 1 - i] * BASE % PRIME
    if key in ats:
        yield key, after[0], -1, True
    before = 0
    for i, c in enumerate(word):
        if c in wanted:
            yield key - value(c), (before * power[m - 1 - i] + after[i + 1]) % PRIME, i, i == 0 or word[i - 1] != c
        before = (before * BASE + ord(c)) % PRIME


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["at", "rest", "place", "fresh", "id", "n"])
        rows.clear()
        return batch

    for b in batches:
        for i, w, n, ats in zip(*(b.column(c).to_pylist() for c in ("id", "word", "n", "ats")), strict=True):
            for r in rests(w, set(ats)):
                rows.append((*r, i, n))
                if len(rows) >= ROWS:
                    yield out()
    if rows:
        yield out()


def near_words(words: DataFrame, keep=settle) -> DataFrame:
    """(id, n_near, best_n, best_id) of words (id, word, n) that have near ones; ids are in the order of the words, for ties."""
    meets = keep(words.select("id", "word").mapInArrow(_meets, MEETS), "meets")
    # A number is of use where two keys arrive; one that is a word's own key is an addition or a removal.
    used = meets.groupBy("at").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("at")
    mine = meets.join(used, "at").groupBy("id").agg(F.collect_set("at").alias("ats"))  # as many as a word has different letters, and one
    parts = keep(words.join(mine, "id").select("id", "word", "n", "ats").mapInArrow(_rests, RESTS), "rests")

    one = F.struct("n", (-F.col("id")).alias("minus"))
    every = lambda *by: Window.partitionBy(*by).orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # At most one word for each letter of the alphabet shares rest and place.
    w = every("at", "rest", "place")
    swaps = parts.where("place >= 0").withColumns({"top": F.first(one).over(w), "next": F.nth_value(one, 2).over(w), "m": F.count("*").over(Window.partitionBy("at", "rest", "place"))})
    swaps = swaps.where("m > 1").select("id", (F.col("m") - 1).alias("near"), F.when(F.col("top.minus") == -F.col("id"), F.col("next")).otherwise(F.col("top")).alias("best"))
    # The word that is the rest, and those that leave it.
    g = Window.partitionBy("at", "rest")
    short = F.when(F.col("place") < 0, one)
    ends = parts.where("fresh").withColumns({"short": F.max(short).over(g), "long": F.max(F.when(F.col("place") >= 0, one)).over(g), "more": F.count(F.when(F.col("place") >= 0, 1)).over(g)})
    ends = ends.where("short is not null and more > 0").select("id", F.when(F.col("place") < 0, F.col("more")).otherwise(1).alias("near"), F.when(F.col("place") < 0, F.col("long")).otherwise(F.col("short")).alias("best"))
    found = swaps.unionByName(ends).groupBy("id").agg(F.sum("near").cast("long").alias("n_near"), F.max("best").alias("best"))
    return found.select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.minus")).alias("best_id"))


def variants(docs: DataFrame, least: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of docs that occurs often enough.

    docs needs doc_id and text; other columns are not looked at. A null or empty text has no words; a row without doc_id keeps its runs
    whole; repeated rows count each. Of near words that are equally frequent the first in code-point order is the form. An
    empty table gives an empty result. Texts and runs may be of any length.
    """
    with Scratch(docs.sparkSession, "variants") as s:
        # Range-sorted, so that ids grow in code-point order (which is that of the bytes).
        words = s.settle(words_of(docs, least), "counts")
        words = s.settle(words.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
        near = words.select("id", "n").join(near_words(words, s.settle), "id", "left").withColumn("f", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_id")))
        near = s.settle(near.select("id", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "f", F.when(F.col("f").isNotNull(), F.col("best_n")).alias("form_n")), "near")
        links = near.where("f is not null").select("id", F.col("f").alias("root"))
        most = near.agg(F.max("n")).first()[0] or 0
        steps = max(0, math.ceil(math.log(max(most, 1) / least, ratio))) if ratio > 1 else 0  # of the longest chain
        for _ in range(max(0, math.ceil(math.log2(max(steps, 1))))):
            on = links.select(F.col("id").alias("root"), F.col("root").alias("further"))
            links = s.settle(links.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root")), "links")
        name = lambda c, w: words.select(F.col("id").alias(c), F.col("word").alias(w))
        out = near.join(links, "id", "left").join(name("id", "word"), "id").join(name("f", "form"), "f", "left").join(name("root", "r"), "root", "left")
        return settle(out.select("word", "form", F.coalesce("r", "word").alias("root"), "n", "n_near", "form_n"), "variants")


def op11_anagram_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_anagram_hashing": op11_anagram_hashing}
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: A CRC is folded over the bytes with a table of 256 entries, which SQL makes first.
SQL = {
    "op11_anagram_hashing": rf"""
WITH RECURSIVE bits AS (SELECT b, 0 AS k, CAST(b AS BIGINT) AS c FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(run, {_FOLD}) AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)),
each_doc AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY 1, 2),
hashed AS (SELECT run, n, coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(doc_id::VARCHAR || ':' || run)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))), 1) AS h FROM each_doc, tab),
cut AS (SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= {LEAST_LETTERS} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
rest AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS w, a.n AS wn, b.word AS v, b.n AS vn FROM rest a JOIN rest b ON a.r = b.r AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM rest a JOIN words b ON a.r = b.word UNION SELECT b.word, b.n, a.word, a.n FROM rest a JOIN words b ON a.r = b.word),
near AS (SELECT w, any_value(wn) AS wn, count(*) AS n_near, arg_max(v, (vn, -rk)) AS v, max(vn) AS vn FROM
  (SELECT p.*, q.rk FROM pairs p JOIN (SELECT word, row_number() OVER (ORDER BY word) AS rk FROM words) q ON p.v = q.word) GROUP BY w),
forms AS (SELECT w AS word, v AS form, vn AS form_n FROM near WHERE vn >= {RATIO} * wn),
walk AS (SELECT word, form AS step FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON walk.step = f.word),
roots AS (SELECT word, step AS root FROM walk WHERE step NOT IN (SELECT word FROM forms))
SELECT words.word, f.form, coalesce(roots.root, words.word) AS root, words.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, f.form_n
FROM words LEFT JOIN near ON near.w = words.word LEFT JOIN forms f ON f.word = words.word LEFT JOIN roots ON roots.word = words.word"""
}
