"""Bounds that hold whatever the table: rounds, sizes of groups, heads of tables, widths."""

import math
import random
from collections import Counter

import public_tokenizers as P
import pytest
from odd import DOCS, sentence

from millrace.llm import op2_line_frequency as op2
from millrace.llm import op3_language as op3
from millrace.llm import op4_packing as op4
from millrace.llm import op6_sstable as op6
from millrace.llm import op10_hidden_markov as op10


def sliding(spark, m, per=12):
    """Documents of `per` lines, each of which shares all but one with the next, as lists of latest posts do."""
    line = lambda k: " ".join(f"l{k}w{j}" for j in range(8))
    return spark.createDataFrame([(i, "\n".join(line(i + j) for j in range(per)), "en", "s", 0) for i in range(m)], DOCS)


def plain_clean(docs, most, left):
    """The rule of clean(), one document after the other in the order of the hash: what is kept, and its text."""
    holders = Counter()
    for _, t in docs:
        holders.update(set(t.split("\n")))
    taken, kept = set(), {}
    for d, t in docs:
        lines = t.split("\n")
        words = sum(len(x.split()) for x in lines)
        free = [x for x in lines if holders[x] <= most or x not in taken]
        if 100 * sum(len(x.split()) for x in free) >= left * words:
            kept[d] = "\n".join(free)
            taken |= {x for x in free if holders[x] > most}
    return kept


def test_rounds_of_owners_do_not_follow_the_documents(spark, monkeypatch):
    rounds, settle = [], op2.Scratch.settle

    def counted(self, df, name):
        rounds.append(name)
        return settle(self, df, name)

    monkeypatch.setattr(op2.Scratch, "settle", counted)
    seen = {}
    for m in (40, 160):
        rounds.clear()
        df = sliding(spark, m)
        got = {r.doc_id: r.text for r in op2.clean(df, most_docs=3).collect()}
        order = [r.doc_id for r in df.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").collect()]
        text = {r.doc_id: r.text for r in df.collect()}
        assert got == plain_clean([(d, text[d]) for d in order], 3, op2.LEFT)
        seen[m] = rounds.count("open")
    assert seen[160] <= seen[40] + 3 and seen[160] <= 4 * math.log2(160)


def test_no_group_of_bins_is_above_its_bound(spark, monkeypatch):
    made, bound = op4._pack_bins, 60

    def checked(level, capacity):
        run = made(level, capacity)

        def bounded(key, pdf):
            if len(pdf) > bound:
                raise ValueError(f"{len(pdf)} bins in one group")
            return run(key, pdf)

        return bounded

    monkeypatch.setattr(op4, "_pack_bins", checked)
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.choice([3, 20, 60, 200])), "en", "s", 0) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = op4.pack_documents(df, P.path("byte_bpe_50k.json"), capacity=256, group_items=bound, fan_in=3).collect()
    fills = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills[r.sequence_id]
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 256 and len({(r.doc_id, r.piece) for r in got}) == len(got) and len({r.doc_id for r in got}) == 400
    assert len(fills) <= 1.1 * sum(fills.values()) / 256 + 5


def test_a_head_of_equal_counts_is_full(spark):
    counts = spark.createDataFrame([(f"w{k}".encode(), 7) for k in range(42)] + [(b"x", 9), (b"y", 1)], "token binary, c long")
    top, least = op10._head(counts, 10)
    assert len(top) == 10 and top[0] == (b"x", 9) and least == 7
    assert len(op10._head(counts, 100)[0]) == 44 and op10._head(counts.limit(0), 5) == ([], 0)
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(42)), "en", "s", 0) for i in range(40)], DOCS)
    rows = op10.score_documents(df, head=10, vocabulary=10).collect()
    assert all(abs(r.score - r.base_score) > 1e-6 and r.n_known == 43 for r in rows)


def test_ids_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, "a word", "en", "s", 0)], DOCS)
    with pytest.raises(Exception, match="does not go into 2 bytes"):
        op6.write_table(df, P.path("word_bpe_49k.json"), 70_000)
    root, manifest = op6.write_table(df, P.path("word_bpe_49k.json"), 70_000, width=4)
    assert manifest.count() == 1


def plain_language(train, text):
    """Words first, then n-grams from long to short; means of log frequencies of the kept entries."""
    langs = sorted({la for la, _ in train})
    counts = {la: {n: Counter() for n in (0, *op3.ORDERS)} for la in langs}
    for la, t in train:
        for w in op3.words_of(t):
            counts[la][0][w] += 1
            for n in op3.ORDERS:
                counts[la][n].update(op3.grams(w, n))
    logs = {}
    for n in (0, *op3.ORDERS):
        least = min((math.log10(c / sum(counts[la][n].values())) for la in langs for c in counts[la][n].values()), default=0) - op3.PENALTY
        for e in {e for la in langs for e in counts[la][n]}:
            logs[n, e] = [math.log10(counts[la][n][e] / sum(counts[la][n].values())) if counts[la][n][e] else least for la in langs]
    total, m = [0.0] * len(langs), 0
    for w in op3.words_of(text):
        found = [logs[0, w]] if (0, w) in logs else next((x for n in op3.ORDERS if (x := [logs[n, g] for g in op3.grams(w, n) if (n, g) in logs])), [])
        if found:
            m += 1
            total = [a + sum(x[k] for x in found) / len(found) for k, a in enumerate(total)]
    if not op3.words_of(text):
        return op3.UNKNOWN, 0.0
    if not m:
        return langs[0], 0.0
    e = [math.exp(op3.SHARPNESS * x / m) for x in total]
    k = max(range(len(langs)), key=lambda i: (total[i], -i))
    return langs[k], e[k] / sum(e)


def test_languages_against_brute_force(spark):
    rng = random.Random(8)
    syllables = {"aa": ["ka", "to", "mi", "ré"], "bb": ["ka", "stra", "ung", "ö"], "cc": ["lo", "to", "ción", "mi"]}
    text = lambda la, n: " ".join("".join(rng.choices(syllables[la], k=rng.choice([1, 2, 3]))) for _ in range(n))
    train = [(la, text(la, 40)) for la in syllables for _ in range(12)]
    model = op3.fit(spark.createDataFrame([(i, t, la) for i, (la, t) in enumerate(train)], "doc_id long, text string, lang string"))
    texts = [text(la, n) for la in syllables for n in (1, 3, 30) for _ in range(5)] + ["", "12 34", "中文 only", "kato xyzzy q", "strakaung lo", "é"]
    got = {r.doc_id: r for r in op3.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        lang, score = plain_language(train, t)
        assert abs(got[i].lang_score - score) < 1e-9 and (got[i].lang_pred == lang or score < 0.5 + 1e-9), (t, got[i], lang, score)
