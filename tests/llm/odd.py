"""Tables that hold what real ones do: nulls, empty and long texts, repeated rows, ties, columns with clashing names."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["k", "h", "own", "node", "part", "bin", "row", "words", "n_words", "kept", "lang_pred", "component_id", "token", "_arrival"]


def sentence(rng, n, size=200):
    return " ".join(f"w{rng.randrange(size)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def odd(spark, extra=True):
    rng = random.Random(5)
    long = "\n".join(sentence(rng, 30, 5000) for _ in range(700))
    base = sentence(rng, 120)
    rows = [
        (0, None, None, None, None), (1, "", "en", "s", 0), (2, " \t\n\r ", "en", "s", 5), (3, "Word", None, "s", 4), (4, long, "en", "s", len(long)),
        (5, base, "en", "s", 9), (5, base, "en", "s", 9), (6, base, "de", None, 9), (None, base, "de", "t", 9), (7, base.upper(), "de", "t", 9),
        (8, "a a a a a a\na a a\n\na a a", "fr", "t", 1), (9, "é 日本 🙂 ß ŉ İ  x\x0bq\x0cz\x1cY", "fr", "t", 1), (10, "### $$$ <|> 12 34", None, "t", 1), (11, "<|endoftext|> x", "en", "t", 2),
        (12, "w1 w2 w3", "en", "t", 2), (-3, "w1 w2 w3", "en", "t", 2),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if extra else df


def none(spark):
    return spark.createDataFrame([], DOCS)


def plain(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
