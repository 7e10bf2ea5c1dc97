"""Quality rules: cross-document line frequency, with DataFrame functions only.

Every line is normalised (A-Z lowered, its words joined by single spaces) and hashed with 64 bits; a line's frequency is
the number of distinct documents of one host (source) that hold it. Lines in more than MOST_DOCS documents of a host are
removed from all of them but the first (the smallest doc_id), and a document that is left with fewer than LEFT percent
of its words is rejected, as are those that fail the base rules (fewer than 50 words, or over half of them in repeated
three-word windows).

Plan: one scan counts lines (rows of one document first, then documents of a line, with a partial aggregate before either
exchange, so that a line of millions of documents costs a row a task), one scan measures documents and looks their lines up. The table of frequent lines, at most one row for
each MOST_DOCS + 1 lines, is broadcast where it has up to BROADCAST_ROWS rows; beyond that, lines meet it in a shuffled
join whose key carries a salt. Texts are shuffled only by clean(), which returns them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, GAP, Scratch, fold_case, settle

MOST_DOCS, LEFT = 10, 30
BROADCAST_ROWS, SALTS = 200_000, 16
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BROADCAST_LINES = 500_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _blank(c: Column) -> Column:
    return F.length(F.translate(c, SPACES, "")) == 0


def _key() -> Column:
    """Rows with equal columns count as one document seen more than once."""
    return F.xxhash64("doc_id", "source", "text")


def _doc() -> Column:
    """The document of a row: its doc_id; rows without one are one document, before all others."""
    return F.coalesce("doc_id", F.lit(-(2**63)))


def _norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(fold_case(line), GAP, " "))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, k, host, h, words, i, first): a row for each line with a word; first: its first one in the document."""
    text = F.coalesce("text", F.lit(""))
    a = docs.select("doc_id", _key().alias("k"), F.col("source").alias("host"), F.filter(F.transform(F.split(text, "\n"), _norm), lambda x: F.length(x) > 0).alias("ls"))
    a = a.select("doc_id", "k", "host", F.sort_array(F.transform("ls", lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words")))).alias("ls"))
    line = F.transform("ls", lambda e, i: F.struct(e["h"].alias("h"), e["words"].alias("words"), i.alias("i"), (~e["h"].eqNullSafe(F.get("ls", i - 1)["h"])).alias("first")))
    return a.select("doc_id", "k", "host", F.explode(line).alias("e")).select("doc_id", "k", "host", "e.*")


def frequent_lines(docs: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, h, n_docs, owner): lines in more than most_docs documents of a host; owner: the first document."""
    held = lines_of(docs).where("first").groupBy("host", "h", _doc().alias("d")).agg(F.count("*").alias("rows"))
    seen = held.groupBy("host", "h").agg(F.count("*").alias("n_docs"), F.min("d").alias("owner"))
    return settle(seen.where(seen.n_docs > most_docs), "lines")


def _meet(rows: DataFrame, table: DataFrame, few: bool, on: list[str], salt: str = "k") -> DataFrame:
    """rows with their lines' row of a table: by broadcast, or by a shuffled join with a salt, as a line may be everywhere."""
    if few:
        return rows.join(F.broadcast(table), on)
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(table, [*on, "_salt"]).drop("_salt")


def _gone(docs: DataFrame, most_docs: int) -> DataFrame:
    """(g_d, g_k, gone, hs): for each row that loses lines, how many words, and the hashes of those lines."""
    often, lines = frequent_lines(docs, most_docs), lines_of(docs)
    a = often.select(F.col("host").alias("o_host"), F.col("h").alias("o_h"), "owner")
    on = lines.host.eqNullSafe(a.o_host) & (lines.h == a.o_h)
    if often.count() <= BROADCAST_ROWS:
        both = lines.join(F.broadcast(a), on)
    else:
        a = a.withColumn("o_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = lines.join(a, on & (F.pmod("k", F.lit(SALTS)) == a.o_salt))
    both = both.where(_doc() != F.col("owner")).select(_doc().alias("g_d"), F.col("k").alias("g_k"), "i", "h", "words").distinct()
    return settle(both.groupBy("g_d", "g_k").agg(F.sum("words").alias("gone"), F.collect_set("h").alias("hs")), "gone")


def _gone_of_kept(docs: DataFrame, most_docs: int, left: int) -> DataFrame:
    """_gone(), where a line stays in the first document that is itself kept.

    As if documents that pass the base came one by one, in the order of a hash of their doc_id: each has the lines that no kept one before
    it holds, is kept if that is enough, and then its lines are taken. By a hash, since chains of documents of which each waits for the one
    before are then short, about the logarithm of their number, where they share lines in the order of their ids. In rounds: a document that is not depleted even
    if all open ones before it took their lines is kept; one that taken lines alone deplete is rejected; the first open one is
    always one or the other. A kept document waits for those of its lines that an open one before it holds: it gets them if that
    one is rejected. A round is over the lines of open documents, and those that kept ones wait for.
    """
    with Scratch(docs.sparkSession, "owners") as s:
        often, line = frequent_lines(docs, most_docs), F.xxhash64("host", "h").alias("l")
        few = often.count() <= BROADCAST_ROWS
        held = _meet(lines_of(docs).select(line, "doc_id", "k", "i", "h", "words"), often.select(line), few, ["l"]).distinct()
        held = s.settle(held.groupBy("l", "h", "doc_id", "k").agg(F.sum("words").alias("words")), "held")
        some = s.settle(held.select("k").distinct(), "holders")
        some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
        # Written first: a filter would be pushed below measure() and evaluate its columns again for each element.
        sized = s.settle(measure(docs.join(some, _key() == some.k, "left_semi")).select("k", "n_words", "n_repeat_words"), "sized")
        sized = sized.where(~_failed()).select("k", "n_words").distinct()
        who = F.struct(F.xxhash64("doc_id").alias("turn"), "doc_id", "k")
        held = s.settle(held.join(sized, "k"), "held")
        rows, owners = held.withColumns({"taken": F.lit(False), "sure": F.lit(False)}), []
        while rows.take(1):
            first = rows.groupBy("l").agg(F.min(F.when(~F.col("taken"), who)).alias("first"))
            x = s.settle(_meet(rows, first, few, ["l"]).withColumn("mine", ~F.col("taken") & who.eqNullSafe(F.col("first"))).drop("first"), "open")
            lost = lambda c: F.sum(F.when(c, F.col("words")).otherwise(0))
            sums = x.where("not sure").groupBy("k", "n_words").agg(lost(~F.col("mine")).alias("most"), lost(F.col("taken")).alias("least"))
            enough = lambda c: 100 * (F.col("n_words") - F.col(c)) >= left * F.col("n_words")
            done = s.settle(sums.where(enough("most") | ~enough("least")).select("k", enough("most").alias("stays")), "done")
            x = s.settle(x.join(done, "k", "left").where(F.coalesce("stays", F.lit(True))).withColumn("sure", F.col("sure") | F.col("stays").isNotNull()).drop("stays"), "left")
            owners.append(s.settle(x.where("mine and sure").select("l", F.col("k").alias("owner")), "owners"))
            now = owners[-1].select("l", F.lit(True).alias("now"))
            now = F.broadcast(now) if few else now
            rest = x.drop("mine").join(now, "l", "left").withColumn("taken", F.col("taken") | F.coalesce("now", F.lit(False))).drop("now")
            rows = s.settle(rest.where("not (sure and taken)"), "rest")
        if not owners:
            # Written too: from an empty literal the optimizer would push the filter on kept below measure().
            return settle(held.select(_doc().alias("g_d"), F.col("k").alias("g_k"), F.col("words").alias("gone"), F.array("h").alias("hs")).limit(0), "gone")
        owned = s.settle(reduce(DataFrame.union, owners), "owners")
        own = [_doc().alias("g_d"), F.col("k").alias("g_k")]
        gone = _meet(held, owned, few, ["l"]).where("k <> owner").groupBy(*own)
        lost = held.join(owned, "l", "left_anti")  # lines of which no holder is kept
        gone = gone.agg(F.sum("words").alias("gone"), F.collect_set("h").alias("hs"))
        more = lost.groupBy(*own).agg(F.sum("words").alias("gone"), F.collect_set("h").alias("hs"))
        return settle(gone.union(more).groupBy("g_d", "g_k").agg(F.sum("gone").alias("gone"), F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs")), "gone")


def measure(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(own, d, k, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each row, own with its carried columns; no exchange.

    Three-word windows are compared by 64-bit hashes within a document. Where two are equal, the windows are sorted with
    their positions, and neighbours mark those that occur twice; each covers three words, less what it shares with the
    one before.
    """
    own = F.struct(*carry).alias("own") if carry else F.lit(None).alias("own")
    t = F.coalesce("text", F.lit(""))
    a = docs.select(own, _doc().alias("d"), _key().alias("k"), t.alias("t"))
    a = a.select("own", "d", "k", "t", F.array_remove(F.split("t", GAP), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: ~_blank(x)).alias("ls"))
    a = a.select(
        "own", "d", "k",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), 1, F.greatest(F.size("w") - 2, F.lit(0))).alias("h"),
    )
    rest = ["own", "d", "k", *COUNTS[:4]]
    a = a.select(*rest, F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("p"))
    twice = F.filter("p", lambda e, i: F.coalesce(e["x"] == F.get("p", i - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get("p", i + 1)["x"], F.lit(False)))
    a = a.select(*rest, F.sort_array(F.transform(twice, lambda e: e["i"])).alias("at"))
    fresh = F.transform("at", lambda v, i: F.least(F.lit(3), v - F.coalesce(F.get("at", i - 1), v - 3)))
    a = a.select(*rest, F.coalesce(F.aggregate(fresh, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long").alias("n_repeat_words"))
    return a.select("own", "d", "k", *COUNTS)


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _judged(docs: DataFrame, gone: DataFrame, left: int, carry: tuple[str, ...]) -> DataFrame:
    rows = measure(docs, carry)
    n, size = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("hs")), F.lit(0))).first()
    if n <= BROADCAST_ROWS and size <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    rows = rows.join(gone, (rows.d == gone.g_d) & (rows.k == gone.g_k), "left").withColumn("n_removed_words", F.coalesce("gone", F.lit(0)).cast("long"))
    failed = _failed()
    # One comparison that needs both sides of the join: a filter on it stays above, where the counts are columns. Pushed
    # down, it would hold their expressions in place of the columns, and evaluate them again for each element.
    kept = F.when(failed, F.lit(-1)).otherwise(100 * (F.col("n_words") - F.col("n_removed_words"))) >= left * F.col("n_words")
    return rows.withColumns({"base_failed": failed, "kept": kept})


def judge(docs: DataFrame, most_docs: int = MOST_DOCS, left: int = LEFT) -> DataFrame:
    """A row for each row of docs: doc_id, the counts, base_failed, n_removed_words, kept.

    docs needs doc_id, source and text; other columns are not looked at. A null text is an empty one, which fails the
    base. A null source is a host of its own. Rows of one doc_id are one document, which counts once, and all of them keep
    the lines of which it is the first holder; rows without doc_id are one, before all others. An empty table gives an empty result.
    """
    return _judged(docs, _gone(docs, most_docs), left, ("doc_id",)).select("own.doc_id", *COUNTS, "base_failed", "n_removed_words", "kept")


def clean(docs: DataFrame, most_docs: int = MOST_DOCS, left: int = LEFT) -> DataFrame:
    """The kept rows of docs with their columns; text is without the removed lines, and n_chars, if any, its length.

    Unlike judge(), whose verdict is that of the query and its SQL, a line stays in the first holder that is kept: no
    line leaves the corpus because its first holder fails the base or is depleted. Other cases as in judge(). A document that loses no line keeps its text as it is.
    """
    rows = _judged(docs, _gone_of_kept(docs, most_docs, left), left, tuple(docs.columns)).where("kept")
    text, whole = F.col("own.text"), F.col("hs").isNull()
    short = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("hs", F.xxhash64(_norm(x)))), "\n")
    new = {"text": F.when(whole, text).otherwise(short)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("own.n_chars")).otherwise(F.length(short)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"own.{c}")).alias(c) for c in docs.columns])


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_line_frequency": op2_line_frequency}
SQL = {
    "op2_line_frequency": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, source, regexp_extract_all(t, '[^ 	-
]+') AS w, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, source, l, array_to_string(regexp_extract_all(translate(l, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^ 	-
]+'), ' ') AS norm,
  len(regexp_extract_all(l, '[^ 	-
]+')) AS n FROM (SELECT doc_id, source, unnest(ls) AS l FROM w)),
li AS (SELECT * FROM ln WHERE n > 0),
freq AS (SELECT source, norm, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS owner FROM li GROUP BY source, norm),
gone AS (SELECT li.doc_id, sum(li.n) AS gone FROM li JOIN freq f ON li.source IS NOT DISTINCT FROM f.source AND li.norm = f.norm
  WHERE f.n_docs > {MOST_DOCS} AND li.doc_id <> f.owner GROUP BY li.doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM li GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
  NOT base_failed AND 100 * (n_words - n_removed_words) >= {LEFT} * n_words AS kept FROM b"""
}
