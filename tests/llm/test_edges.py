"""Every operator over odd and empty tables, against plain versions."""

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter

import public_tokenizers as P
import pytest
from odd import DOCS, none, odd, plain
from pyspark.sql import functions as F

from millrace.llm import op1_compaction as op1
from millrace.llm import op2_line_frequency as op2
from millrace.llm import op3_language as op3
from millrace.llm import op4_packing as op4
from millrace.llm import op6_sstable as op6
from millrace.llm import op7_license_scan as op7
from millrace.llm import op8_byte_bpe as op8
from millrace.llm import op9_jaccard as op9
from millrace.llm import op10_hidden_markov as op10

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE, WORDS, RANKS = (P.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def test_shards(spark):
    rows = odd(spark)
    got = op1.shard_documents(rows).read()
    assert sorted(map(repr, got.select(*rows.columns).collect())) == sorted(map(repr, rows.collect())) and "arrival" in got.columns
    assert op1.shard_documents(none(spark)).read() is None


def plain_counts(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    covered = {i + j for i, x in enumerate(win) if c[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_line_frequency(spark):
    rows = odd(spark)
    got = op2.judge(rows)
    want = [(d, *plain_counts(t)) for d, t in plain(rows)]
    assert sorted(map(repr, map(tuple, got.select("doc_id", *op2.COUNTS).collect()))) == sorted(map(repr, want))
    assert op2.judge(none(spark)).count() == 0 and op2.clean(none(spark)).count() == 0
    kept = op2.clean(rows)
    assert kept.columns == rows.columns and kept.count() == got.where("kept").count()


def test_lines_above_the_limit_go(spark):
    body = lambda i: " ".join(f"x{i}y{j}" for j in range(80))
    shared = "Shared  LINE of the\thost"
    rows = [(i, body(i) + "\n" + shared + ("\n" + shared.lower() if i == 3 else ""), "en", "a" if i < 14 else "b", 0) for i in range(20)]
    rows += [(100 + i, "\n".join(["same copy " * 30, "of everything " * 30]), "en", "c", 0) for i in range(12)]
    df = spark.createDataFrame(rows, DOCS)
    for most_rows in (op2.BROADCAST_ROWS, -1):  # by broadcast, and by a salted join
        old, op2.BROADCAST_ROWS = op2.BROADCAST_ROWS, most_rows
        try:
            text = {r.doc_id: (r.text, r.n_chars) for r in op2.clean(df).collect()}
            lost = {r.doc_id: r.n_removed_words for r in op2.judge(df).collect()}
        finally:
            op2.BROADCAST_ROWS = old
        assert sum(shared in text[d][0] for d in range(14)) == 1 and text[15][0].endswith(shared)
        assert all(text[d] == (body(d), len(body(d))) for d in range(14) if shared not in text[d][0])
        assert lost[0] == 0 and lost[5] == 5 and lost[3] == 10 and lost[100] == 0 and lost[101] == 120
        assert 101 not in text


@pytest.mark.parametrize("most_rows", [op2.BROADCAST_ROWS, -1])
def test_lines_stay_in_a_document_that_is_kept(spark, monkeypatch, most_rows):
    """The first holder fails the base, or is depleted: the line stays in the next holder that is kept; against documents
    taken one by one, in the order of the hash."""
    import random

    monkeypatch.setattr(op2, "BROADCAST_ROWS", most_rows)
    rng = random.Random(8)
    line = lambda n: " ".join(f"{n}w{j}" for j in range(20))
    abc = [line("A"), line("B"), line("C")]
    rows = [(1, "\n".join(abc * 3), "en", "a", 0)] + [(i, "\n".join(abc), "en", "a", 0) for i in range(2, 14)]
    # 50 takes P; 51 waits for P and is rejected; 52 is kept at once and gets Q, which 51 holds before it, as do 53 to 70.
    rows += [(50, line("P1") + "\n" + line("P2") + "\n" + line("P3"), "en", "c", 0), (51, "\n".join([line("P1"), line("P2"), line("P3"), line("Q")]), "en", "c", 0)]
    rows += [(i, "\n".join([line(f"own{i}a"), line(f"own{i}b"), line("Q"), line("P1"), line("P2"), line("P3")]), "en", "c", 0) for i in range(52, 71)]
    for i in range(24):
        own = [line(f"o{i}x{j}") for j in range(rng.randrange(3))]
        rows.append((100 + i, "\n".join(own + [line(f"s{j}") for j in rng.sample(range(8), rng.randrange(3, 8))]), "en", "b", 0))
    n, want, taken = Counter((r[3], x) for r in rows for x in set(r[1].split("\n"))), {}, set()
    df = spark.createDataFrame(rows, DOCS)
    turn = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    for d, t, _, host, _ in sorted(rows, key=lambda r: turn[r[0]]):
        ls = t.split("\n")
        stay = [x for x in ls if n[host, x] <= op2.MOST_DOCS or (host, x) not in taken]
        if d != 1 and 100 * len(stay) >= op2.LEFT * len(ls):
            want[d] = "\n".join(stay)
            taken |= {(host, x) for x in ls}
    got = {r.doc_id: r.text for r in op2.clean(df).collect()}
    assert got == want and 1 not in got and [got[d] for d in range(2, 14) if d in got] == ["\n".join(abc)]


def test_language(spark):
    rows = odd(spark)
    model = op3.fit(rows)
    got = op3.predict(rows, model)
    by = {(r.doc_id, r.text): (r.lang_pred, r.lang_score) for r in got.collect()}
    assert by[0, None] == ("und", 0.0) and by[1, ""][0] == "und" and by[10, "### $$$ <|> 12 34"] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in by.values()) and set(got.columns) >= set(rows.columns)
    assert model.scores("½ ² Ⅷ ① 12_3")[0] == "und" and op3.words_of("a½b Ça ⅷ x_y") == ["a", "b", "ça", "x", "y"]
    empty = op3.fit(none(spark))
    assert empty.languages == [] and {r.lang_pred for r in op3.predict(rows, empty).collect()} == {"und"}


def test_language_held_out_accuracy(spark, data):
    r = op3.op3_language(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    good = r.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert good[0] >= 0.95 and good[1] > 20


def test_backoff_is_word_first():
    m = op3.Model(["a", "b"], {0: {"the": (-1.0, -9.0)}, 3: {"<th": (-9.0, -1.0)}, 1: {"z": (-2.0, -1.0)}})
    assert m.word("the") == (-1.0, -9.0) and m.word("thx") == (-9.0, -1.0) and m.word("zq") == (-2.0, -1.0) and m.word("qq") is None


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORDS, False)])
def test_encoders_equal_the_plain_library_call(path, spaced):
    """Strings of added tokens, with and without spaces around them, odd spaces, long chunks, a memo that overflows."""
    import random

    from millrace.llm import encoders

    rng, ids = random.Random(9), library(path)
    parts = ["a", " ", "  ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "the", "Word,", "x.", "\n", "\t ", "日本語", "é", "\u200b", "\ufeff", "12", "it's", "q" * 90, "\u3000"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    e = encoders.library_encoder(path, spaced)
    e.memo = 30_000
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        assert [list(array("I", x)) for x in e.texts(part)] == [ids(t) for t in part]
    assert all(len(c) <= encoders.LONG for c in e.known)


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORDS, False)])
def test_words_with_marks_and_line_ends_are_encoded_in_lines(path, spaced):
    """Capitals, accents, marks after words and on both sides of an end of line: right ids, and few strings for the library."""
    import random

    from millrace.llm import encoders

    rng, ids = random.Random(4), library(path)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvzABCDEFÀÉÎÑßéèñüÿ") for _ in range(rng.randrange(1, 12)))
    mark = lambda: rng.choice(["", "", ",", ".", "!!", "$$$", ".%%%", "?)", "-", "_", "<|", "\\"])
    texts = [" ".join(word() + mark() + (f"\n{word()}{mark()}" if rng.random() < 0.3 else "") for _ in range(60)) for _ in range(100)]
    texts += ["it's a.\n'S x", "a\n\nb c.\n d", "µa ªb a×b a÷ İx e\u0301a Ça.\nÇa"]
    e = encoders.library_encoder(path, spaced)
    assert [list(array("I", x)) for x in e.texts(texts)] == [ids(t) for t in texts]
    e, single = encoders.library_encoder(path, spaced), []
    plain, e.encode = e.encode, lambda strings: single.extend(strings) or plain(strings)
    e.texts(texts)
    assert len(single) < 300  # first words of texts, marks and what is neither; 6 000 chunks of words go in lines


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORDS, False)])
def test_encoders_learn_words_once_whatever_stands_beside_them(path, spaced):
    """Marks, digits and ends of lines around few words: the memo grows with the words, not with their neighbours."""
    import random

    from millrace.llm import encoders

    rng, ids = random.Random(7), library(path)
    words = ["".join(rng.choice("abcdefgÉèñü") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    word = lambda: rng.choice("  (") + rng.choice(words) + rng.choice(["", ",", ".", "12", "-", ";"])
    texts = [" ".join(word() + "\n" + word() for _ in range(60)) for _ in range(100)]
    e = encoders.library_encoder(path, spaced)
    assert [list(array("I", x)) for x in e.texts(texts)] == [ids(t) for t in texts]
    assert len(e.known) < 250  # 60 words with and without a space, marks, digits; 6 000 chunks between spaces


def test_packing_with_a_tokenizer_that_splits_in_another_way(spark, tmp_path):
    """A file that puts a space before each text cannot be encoded in pieces: ids are the library's all the same."""
    import json

    spec = json.loads(open(BYTE).read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(spec, f)
    texts, ids = ["foo, bar.\nBaz", "x (y) z.", None, "", " a"], library(path)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = op4.pack_documents(df, path).collect()
    packs(got, [(d, [*ids(t or ""), 0]) for d, t in enumerate(texts)], 2048)


def packs(got, want, capacity):
    """Pieces cover each document's ids, in order; sequences have no gaps and do not overflow."""
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    plain_pieces = Counter()
    for d, ids in want:
        first = len(ids) % capacity or min(capacity, len(ids))
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            plain_pieces[(d, k, a, b - a, crc(ids[a:b]))] += 1
    assert pieces == plain_pieces
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, capacity):
    rows, ids = odd(spark).repartition(5), library(BYTE)
    n = packs(op4.pack_documents(rows, BYTE, capacity=capacity, fan_in=2).collect(), [(d, ids(t) + [0]) for d, t in plain(rows)], capacity)
    total = sum(len(ids(t)) + 1 for _, t in plain(rows))
    assert math.ceil(total / capacity) <= n <= math.ceil(total / capacity) + 2
    assert op4.pack_documents(none(spark), BYTE).count() == 0


def test_packing_rounds(spark):
    """Many partitions whose residue meets in a tree: close to the least number of sequences."""
    df = spark.range(600, numPartitions=16).selectExpr("id doc_id", "repeat('ab ', cast(1 + (id * 7919) % 290 as int)) text")
    got = op4.pack_documents(df, BYTE, capacity=512, fan_in=3).collect()
    ids = library(BYTE)
    want = [(r.doc_id, ids(r.text) + [0]) for r in df.collect()]
    n = packs(got, want, 512)
    assert n <= 1.02 * sum(len(i) for _, i in want) / 512 + 1


@pytest.mark.parametrize("group_items", [200_000, 40])
def test_packing_of_many_partitions_is_as_good_as_of_one(spark, data, group_items):
    """Of pieces in 32 partitions there is at most a sequence more than of pieces in one, whatever a group may hold."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one, many = (op4.pack_documents(docs.repartition(n), BYTE, group_items=g).select("sequence_id").distinct().count() for n, g in ((1, 200_000), (32, group_items)))
    assert many <= one + (1 if group_items > 1000 else 0.1 * one)


def test_best_fit_takes_the_tightest():
    where, offset, fill = op4.best_fit([6, 5, 4, 3, 2], 10)
    assert fill == [10, 10] and where == [0, 1, 0, 1, 1] and offset == [0, 0, 6, 5, 8]


def test_tables_of_ids(spark):
    rows, ids = odd(spark), library(WORDS)
    root, manifest = op6.write_table(rows, WORDS, 2)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op6.scan_table(spark, root).orderBy("start").collect()]
    want = Counter((d, len(ids(t)) + 1, crc(ids(t) + [2])) for d, t in plain(rows))
    assert Counter((d, n, c) for d, _, n, c in got) == want
    assert [d for d, *_ in got] == sorted((d for d, _ in plain(rows)), key=lambda d: (d is not None, d or 0))
    at = 0
    for _, s, n, _ in got:
        assert s == at
        at += n
    assert op6.lookup(spark, root, -3) == [ids("w1 w2 w3") + [2]] and len(op6.lookup(spark, root, 5)) == 2 and op6.lookup(spark, root, 99) == []
    root, manifest = op6.write_table(none(spark), WORDS, 2)
    assert manifest.count() == 0 and op6.scan_table(spark, root).count() == 0


def test_licenses(spark):
    rows = odd(spark)
    assert op7.scan_documents(rows).count() == 0 and op7.scan_documents(none(spark)).count() == 0
    text = f"é intro\n{op7.TEMPLATES['MIT'].replace('Software', 'Library', 3)}\nend. Licensed under CC BY-NC 4.0. Released under\tthe MIT license!"
    df = spark.createDataFrame([(1, text, "en", "s", 0), (1, text, "en", "s", 0)], DOCS)
    got = op7.scan_documents(df).collect()
    assert Counter(r.license for r in got) == {"MIT": 2, "CC-BY-NC-4.0 notice": 2, "MIT notice": 2}
    for r in got:
        assert op7.words_of(text[r.start : r.end])[0] == op7.words_of(op7.TEMPLATES[r.license])[0] and r.coverage > 0.95


def test_alignment_equals_full_alignment():
    import random

    import numpy as np

    rng = random.Random(2)
    for _ in range(30):
        template = [rng.randrange(30) for _ in range(40)]
        text = [rng.randrange(30, 60) for _ in range(25)] + [x for x in template if rng.random() > 0.05] + [rng.randrange(60) for _ in range(20)]
        banded, wide = (op7.align(template, np.array(text), 25, 25, 0, len(text), band=b)[0] for b in (8, 200))
        assert banded == wide == plain_alignment(template, text)


def plain_alignment(template, text):
    """Matches of the best local alignment, over all cells."""
    before, best = [(0, 0)] * (len(template) + 1), (0, 0)
    for w in text:
        row = [(0, 0)]
        for i, x in enumerate(template):
            d = before[i]
            cell = max((d[0] + 2, d[1] + 1) if w == x else (d[0] - 1, d[1]), (before[i + 1][0] - 1, before[i + 1][1]), (row[i][0] - 1, row[i][1]))
            row.append(cell if cell[0] > 0 else (0, 0))
        best, before = max(best, *row), row
    return best[1]


def test_whole_scan_against_full_alignment(spark):
    """A table of texts that hold damaged templates, others' words and repeated phrases: every template that a full alignment
    finds covered is reported, or lies within a better one."""
    import random

    rng, rows = random.Random(4), []
    names = sorted(op7.TEMPLATES)
    for i in range(40):
        words = [f"z{rng.randrange(50)}" for _ in range(rng.randrange(40))]
        for n in rng.sample(names, rng.randrange(3)):
            words += [w.decode() if rng.random() > 0.03 else "odd" for w in op7.words_of(op7.TEMPLATES[n])] + ["q"] * rng.randrange(30)
        rows.append((i, " ".join(words + ["the", "following", "disclaimer"] * rng.randrange(20))))
    got = {}
    for r in op7.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        found = {r.license: r.n_matched for r in got.get(i, [])}
        for n in names:
            template = op7.words_of(op7.TEMPLATES[n])
            most = plain_alignment(template, op7.words_of(t))
            if n in found:
                assert found[n] <= most and found[n] >= op7.COVERAGE * len(template)
            elif most >= op7.COVERAGE * len(template) and op7.marks(template) <= op7.marks(op7.words_of(t)):
                assert any(k >= most for k in found.values()), (i, n, most, found)


def test_repeated_phrases_are_scanned_in_time():
    import time

    index, start = op7.Index.of(op7.TEMPLATES), time.time()
    assert index.scan(" ".join(["the following disclaimer"] * 7000)) == [] and time.time() - start < 2


def test_byte_bpe(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = odd(spark)
    want = Counter()
    for d, t in plain(rows):
        ids = enc.encode_ordinary(t)
        want[(d, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(map(tuple, op8.digest_documents(rows, RANKS, P.PATTERN).collect())) == want
    back = op8.encode_documents(rows, RANKS, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back) == Counter(plain(rows))
    assert op8.digest_documents(none(spark), RANKS, P.PATTERN).count() == 0


def sets_of(rows):
    out = []
    for d, t in rows:
        w = WORD.findall(t.translate(FOLD))
        out.append((d, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def plain_components(rows):
    """(doc_id, n, component) of each row, by comparing every pair."""
    sets = sets_of(rows)
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (d, s) in enumerate(sets):
        for j in range(i):
            e, t = sets[j]
            if s and t and d is not None and e is not None and 100 * len(s & t) >= 75 * len(s | t):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, len(s), None if d is None else least[top(i)]) for i, (d, s) in enumerate(sets))


def test_jaccard(spark):
    rows = odd(spark)
    assert Counter(map(tuple, op9.components(rows).collect())) == plain_components(plain(rows))
    assert op9.components(none(spark)).count() == 0
    one = op9.one_of_each(rows)
    assert one.columns == rows.columns


def test_one_row_of_each_component(spark):
    """Row by row: repeated rows, rows that share a doc_id but not a text, rows without doc_id or without words."""
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(1, x), (1, x), (2, x), (None, x), (None, y), (3, y), (2, y), (4, None), (4, ""), (4, ""), (2, x.upper())]
    got = op9.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter([(1, x), (None, x), (None, y), (2, y), (4, None), (4, ""), (4, "")])


def test_jaccard_in_large_groups(spark, monkeypatch):
    """Near copies in chains and crowds, with a passage that all share, small limits so that every path is taken."""
    import random

    rng = random.Random(11)
    for name, value in (("SMALL", 6), ("CHUNK", 9), ("PART", 20), ("WIDE_PAIRS", 40), ("CELL", 11)):
        monkeypatch.setattr(op9, name, value)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(110)]
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(100)]
    for k in range(20):
        texts.append(" ".join(chain[3 * k : 3 * k + 60]))
    for k in range(40):
        texts.append(" ".join(f"u{k}x{i}" for i in range(60)) + " " + passage)
    texts += [" ".join(f"s{i}" for i in range(n)) for n in range(1, 14)] * 2
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert Counter(map(tuple, op9.components(df).collect())) == plain_components(list(enumerate(texts)))


@pytest.mark.parametrize("rounds", [3, 0])
def test_jaccard_past_wide_ranges(spark, monkeypatch, rounds):
    """A passage in many documents, near copies among them: links are found inside the groups, by new signatures or in cells of
    a shuffle, and no set passes through the driver."""
    import random

    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(op9, "WIDE_ROUNDS", rounds)
    monkeypatch.setattr(op9, "WIDE_PAIRS", 100)
    monkeypatch.setattr(op9, "CELL", 25)
    collect = DataFrame.collect

    def narrow(df):
        assert not {"items", "text", "bits"} & set(df.columns)
        return collect(df)

    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(60):
        base = passage + [f"u{k}x{i}" for i in range(60)]
        for _ in range(2):
            w = list(base)
            for _ in range(2):
                w[60 + rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", narrow)
        out = op9.components(df)
    assert Counter(map(tuple, out.collect())) == plain_components(list(enumerate(texts)))


def test_scores(spark):
    rows = odd(spark)
    for head in (op10.HEAD, 40):
        got = op10.score_documents(rows, vocabulary=30, head=head, warm_docs=5, rounds=1).collect()
        tokens = [(d, WORD.findall(t.translate(FOLD)) + ["\n"]) for d, t in plain(rows)]
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
        c = Counter(w for d, ts in tokens if not held(d) for w in ts)
        n, v = sum(c.values()), len(c)
        want = Counter((d, held(d), len(ts), sum(c[w] > 0 for w in ts), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), 6)) for d, ts in tokens)
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert op10.score_documents(none(spark)).count() == 0
    nothing = op10.score_documents(spark.createDataFrame([(2, "a b")], "doc_id long, text string"), rounds=1)
    assert nothing.count() == 1
