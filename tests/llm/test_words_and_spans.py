"""Spelling variants, personal data and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import DOCS, none, odd, plain
from pyspark.sql import functions as F

from millrace.llm import op11_anagram_hashing as op11
from millrace.llm import op12_pii as op12
from millrace.llm import op13_collocations as op13

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, least=5, ratio=5):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = run.translate(FOLD)
            if d is not None and (h := zlib.crc32(f"{d}:{run}".encode())) % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= least}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n}


def some_words(rng, m):
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([6, 7, 8]))) for _ in range(m)]
    out = {}
    for w in base:
        out[w] = out[w + rng.choice("abß")] = out["ÿ" + w[1:]] = out[w[:2] + w[3:]] = 1
    return list(out)


def test_variants(spark):
    rng = random.Random(3)
    words = some_words(rng, 60) + ["aaaaaaa", "aaaaaa", "aaaaaab", "aaaaaaaa"]
    weights = [rng.choice([1, 1, 6, 40, 250]) for _ in words]
    rows = [(i if i % 9 else None, " ".join(w if rng.random() < 0.9 else w.upper() for w in rng.choices(words, weights, k=150)), "en", "s", 0) for i in range(60)]
    rows += [(100 + k, " ".join([w] * n), "en", "s", 0) for k, (w, n) in enumerate([("chainaa", 8), ("chainab", 60), ("chainbb", 400), ("chainbbb", 3000)])]
    df = spark.createDataFrame(rows, DOCS)
    got = {tuple(r) for r in op11.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_variants([(r[0], r[1]) for r in rows])
    assert got == want and sum(1 for x in want if x[1] is not None and x[1] != x[2]) >= 2 and max(x[4] for x in want) > 3


def test_variants_of_odd_tables(spark):
    rows = odd(spark)
    got = op11.variants(rows, least=1)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_variants(plain(rows), least=1)
    assert op11.variants(none(spark)).count() == 0
    long = "ab" * 150_000  # one word of 300 000 letters, and one without its last
    rows = spark.createDataFrame([(1, long, "", "", 0)] * 6 + [(2, long[:-1], "", "", 0)] * 30, DOCS)
    found = {len(r.word): r for r in op11.variants(rows).collect()}
    assert len(found[300_000].form) == 299_999 and found[299_999].n_near == 1 and found[299_999].form is None


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=1, max_size=7), st.text("abé", min_size=1, max_size=7))
def test_keys_meet_where_words_are_near(a, b):
    def at(w):
        key = sum(map(op11.value, w))
        return {(x, r, p) for x, r, p, _ in op11.rests(w, {key, *(key - op11.value(c) for c in w)})}

    x, y = at(a), at(b)
    swaps = {s for s in x & y if s[2] >= 0}
    ends = {(s[0], s[1]) for s in x if s[2] < 0} & {(s[0], s[1]) for s in y if s[2] >= 0} | {(s[0], s[1]) for s in y if s[2] < 0} & {(s[0], s[1]) for s in x if s[2] >= 0}
    assert (a != b and bool(swaps or ends)) == (a != b and one_apart(a, b))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    table = "0246813579"
    return sum(int(c) if k % 2 == 0 else int(table[int(c)]) for k, c in enumerate(digits[::-1])) % 10 == 0


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "@@", ".", "_", "-", " ", "+", "1", "25", "255", "256", "0", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "+1 (310) 555-4510", "x@y.z", "\n", "é"]), max_size=14).map("".join))
def test_patterns(text):
    assert op12.base_spans(text) == plain_spans(text)


def test_patterns_of_long_texts():
    for x in ("1", "1.", "1 ", "a@", "a", "+1", "@", "a.", "1-"):
        assert isinstance(op12.base_spans(x * 300_000), list)
        assert sum(e - a for a, e in op12.windows(x * 100_000)) <= 100_000 * len(x)


def test_field(spark):
    field = op12.fit(op12.labelled(spark))
    right = wrong = missed = 0
    for r in op12.labelled(spark, each=10, seed=77).collect():  # other data in the same lines
        base, got = op12.all_spans(field, [r.line])[0]
        want = {(a, op12.KINDS.index(k), e) for k, a, e in r.spans}
        new = set(got) - set(base)
        right, wrong, missed = right + len(want & set(got)), wrong + len(new - want), missed + len(want - set(got))
    assert right >= 0.95 * (right + missed) and wrong <= 0.02 * right
    found = lambda t: [t[a:e] for a, _, e in op12.all_spans(field, [t])[0][1]]
    assert found("so jane dot doe at mail dot example dot com it is") == ["jane dot doe at mail dot example dot com"]
    assert found("or call (310) 555-4510 now") == ["(310) 555-4510"]
    assert found("we met at noon, in 1999, on the dot at 12 of 340 pages") == []


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    f = op12.Field(rng.normal(0, 1, (2 * op12.REACHED + 1, len(op12.SHAPES), 9)), rng.normal(0, 1, (10, 9)))
    sizes = np.array([4, 4, 2, 1])
    ids = rng.integers(1, len(op12.SHAPES), (4, 4)) * (np.arange(4)[None] < sizes[:, None])
    got, e, move = f.decode(ids, sizes), f.scores(ids), f.move + op12._allowed()
    for r, n in enumerate(sizes.tolist()):
        best = None
        for path in np.ndindex(*[9] * n):
            s = move[-1, path[0]] + sum(e[r, k, y] for k, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False))
            best = max(best or (s, path), (s, path))
        assert tuple(got[r, :n].tolist()) == best[1]


def test_training_climbs_the_likelihood_that_the_recursion_gives():
    """A numeric derivative of the likelihood of one small table, at the end of training, is that of the penalty."""
    sequences = [([3, 40, 3, 5], [0, 1, 2, 0]), ([40, 3], [1, 0]), ([5, 5, 40], [0, 0, 3])]
    weight = 0.05
    f = op12.train(sequences, rounds=1500, rate=0.02, weight=weight)

    def value(f):
        total = 0.0
        for x, y in sequences:
            e, move = f.scores(np.array([x]))[0], f.move + op12._allowed()
            every = [move[-1, p[0]] + sum(e[k, v] for k, v in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in np.ndindex(*[9] * len(x))]
            gold = move[-1, y[0]] + sum(e[k, v] for k, v in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False))
            total += gold - np.logaddexp.reduce(every)
        return total / len(sequences) - weight / 2 * ((f.near**2).sum() + (f.move**2).sum())

    at = value(f)
    for w, k in ((f.near, (3, 40, 1)), (f.near, (3, 3, 0)), (f.move, (1, 2)), (f.move, (9, 0))):
        old = w[k]
        w[k] = old + 1e-3
        more = value(f)
        w[k] = old
        assert abs(more - at) < 1e-4  # a maximum


def test_personal_data_of_odd_tables(spark):
    rows = odd(spark).union(spark.createDataFrame([(20, "a.b@c.de 10.0.0.1 +1 (310) 555-4510", "en", "s", 1), (21, "x 4111.1111.1111.1111", "en", "s", 1)], DOCS).select("*", *[F.lit("x") for _ in range(len(odd(spark).columns) - 5)]))
    got = op12.find(rows).collect()
    want = []
    for d, t in plain(rows):
        s = plain_spans(t)
        text = ",".join(f"{op12.KINDS[k]}:{a}:{e}" for a, k, e in s)
        want.append((d, *(sum(x[1] == k for x in s) for k in range(4)), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(repr, ((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got))) == sorted(map(repr, want))
    assert {r.doc_id: r.spans for r in got}[21] == "card:2:21" and {r.doc_id: r.n_added for r in got}[21] == 1
    assert op12.find(none(spark)).count() == 0
    nothing = spark.createDataFrame([], "line string, spans array<struct<kind:string,from:int,to:int>>")
    assert all(r.n_added == 0 for r in op12.find(rows, nothing).collect())


def plain_collocations(docs, least, most, cover=80):
    n, f = Counter(), defaultdict(Counter)
    for lang, t in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, le, r) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, i, p.decode(), -a, le, r, n[lang], -s))
    return sorted(out)


def phrases_table(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["New York", "of the", "the", "of", "a b c d", "É é", "x"]) + rng.choice(["", "", ",", "\n", " .. "]) for _ in range(60))
    rows = [(i, text(), rng.choice(["en", "de", None, "und"]), "s", 0) for i in range(60)] + [(99, None, "en", "s", 0), (100, " ,. ", "en", "s", 0), (101, "a " * 40_000, "fr", "s", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_collocations(spark):
    df = phrases_table(spark)
    docs = [(r.lang, r.text) for r in df.collect()]
    for least, most, automaton, bits in ((30, 2000, 10**6, None), (5, 7, 10**6, None), (5, 2000, 20, 16)):  # the last: many automata
        got = op13.collocations(df, least, most, automaton=automaton, bits=bits).collect()
        assert sorted(map(tuple, got)) == plain_collocations(docs, least, most)
        assert len(got) > 5


def test_collocations_lose_nothing_with_few_counters(spark):
    """With next to no counters every phrase is a candidate; the result is the same."""
    df = phrases_table(spark)
    assert sorted(map(tuple, op13.collocations(df, 8, bits=4).collect())) == plain_collocations([(r.lang, r.text) for r in df.collect()], 8, 2000)


def test_collocations_of_odd_tables(spark):
    rows = odd(spark)
    got = op13.collocations(rows, 2)
    assert sorted(map(tuple, got.collect())) == plain_collocations([(r.lang, r.text) for r in rows.collect()], 2, 2000)
    assert op13.collocations(none(spark)).count() == 0


def test_queries_against_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    p = Path(f"{data}/documents.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW documents AS SELECT * FROM '{p}'")
    for m in (op11, op13):
        ((name, query),) = m.QUERIES.items()
        got = query(spark, data)
        want = con.sql(m.SQL[name])
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
