"""Parts that need no table, or a small one."""

import io
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from odd import none
from pyspark.sql import functions as F

from millrace.llm import op1_compaction as op1
from millrace.llm import op5_collision_hashing as op5
from millrace.llm import op6_sstable as op6
from millrace.llm import op7_license_scan as op7
from millrace.llm import op8_byte_bpe as op8
from millrace.llm import op9_jaccard as op9
from millrace.llm import op10_hidden_markov as op10
from millrace.llm.common import connected_components


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
    rows = sorted((s, i) for s, i in zip(d.tolist(), ids, strict=True) if i != q)
    return rows[:k]


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[200:260] = x[7]
    ids = list(range(1500))
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    rows += [(None, rows[0][1]), (5000, None), (5100, []), (5200, [0.0] * 24), (5300, [float("nan")] * 24), (5400, [None] + [1.0] * 23), (5500, [1.0] * 3), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("query_id", F.lit(1)).repartition(3)
    got = op5.nearest(df, df.where("vec_id % 100 = 0"), block_rows=400)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 100))
    hit = 0
    for q, found in by.items():
        found.sort()
        want = brute(ids, x.astype(np.float64), q, 10)
        assert [r for r, _, _ in found] == list(range(1, 11))
        hit += len({i for _, i, _ in found} & {i for _, i in want})
        if q == 200:
            assert [i for _, i, _ in found] == [7, *range(201, 210)] and found[0][2] == 0
    assert hit >= 0.9 * 150
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert op5.nearest(few, few.where("vec_id % 100 = 0")).count() == 3
    assert op5.nearest(few.limit(0), few.limit(0)).count() == 0


def test_neighbours_of_the_table(spark, data):
    """Recall on a whole table, also with queries in several chunks."""
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding]
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    for size in (op5.QUERY_BYTES, 4_000):
        by = {}
        for r in op5.nearest(df, df.where("vec_id % 20 = 0"), query_bytes=size).collect():
            by.setdefault(r.query_id, set()).add(r.vec_id)
        want = {q: {i for _, i in brute(ids, x, q, 10)} for q in ids if q % 20 == 0}
        assert set(by) == set(want)
        assert sum(len(by[q] & want[q]) for q in want) >= 0.9 * sum(len(v) for v in want.values())


def test_neighbours_verify_few_in_clusters():
    """With a bound as from a sample: few vectors are verified, and blocks of other clusters are not opened."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32)) * 4
    x = (centres[:, None, :] + rng.normal(size=(20, 200, 32))).reshape(-1, 32)
    ids = list(range(len(x)))
    blocks = [op5.Index(np.array(ids[a : a + 200]), x[a : a + 200]) for a in range(0, len(x), 200)]
    opened = hit = 0
    queries = ids[::100]
    for q in queries:
        at, found = x[q] @ op5.lines_of(32), (np.empty(0), np.empty(0, dtype=np.int64))
        want = brute(ids, x, q, 10)
        bound = want[-1][0] * 1.1
        for b in blocks:
            if b.touched(x[q][None], at[None], np.array([bound]))[0]:
                opened += 1
                found = b.nearest(x[q], at, q, 10, found, bound)
        hit += len({i for _, i in want} & set(found[1].tolist()))
    assert hit >= 0.9 * 10 * len(queries)
    assert opened < 0.1 * len(queries) * len(blocks)
    assert sum(b.verified for b in blocks) < 0.05 * len(queries) * len(x)


def test_neighbours_beyond_the_range_of_squares(spark):
    rows = [(i, [1e300 * (i + 1), 1.0]) for i in range(5)] + [(10 + i, [float(i), 2.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = op5.nearest(df, df.where("vec_id in (1, 11)"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(1, 0), (1, 2), (1, 3), (11, 10), (11, 12), (11, 13)]
    assert [r.score for r in got][3:] == [1.0, 1.0, 2.0]


def edges_of(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(40)]


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    rng = random.Random(4)
    edges = edges_of(rng, 120, 70)
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task)
    want = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in got.collect()} == want


def test_forward_is_exact():
    """The scaled recursion against the sum over all paths; rows of unequal length side by side; rounds never lose likelihood."""
    rng = np.random.default_rng(0)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = op10.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    texts = [rng.integers(0, 5, n) for n in (6, 4, 4, 1)]
    got = {}
    for numbers, tokens, sizes in op10.side_by_side(texts):
        got |= dict(zip(numbers.tolist(), m.forward(tokens, sizes).tolist(), strict=True))
    for i, t in enumerate(texts):
        p = 0.0
        for path in itertools.product(range(3), repeat=len(t)):
            q = m.first[path[0]] * m.emit[t[0], path[0]]
            for a, b, w in zip(path, path[1:], t[1:], strict=False):
                q *= m.move[a, b] * m.emit[w, b]
            p += q
        assert got[i] == pytest.approx(np.log(p))
    texts, last = [rng.integers(0, 5, rng.integers(1, 30)) for _ in range(40)], -np.inf
    for _ in range(6):
        into, total = m.zero(), 0.0
        for _, tokens, sizes in op10.side_by_side(texts):
            total += m.expect(tokens, sizes, into)
        assert total >= last - 1e-6 and into.emit.sum() == pytest.approx(sum(map(len, texts)))
        last, m = total, op10.Hmm(into.first / into.first.sum(), into.move / into.move.sum(1, keepdims=True), into.emit / into.emit.sum(0))


def test_stretches_of_long_texts_count_the_same():
    rng = np.random.default_rng(5)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = op10.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    texts = [rng.integers(0, 5, n) for n in (1, 2, 3, 20, 21, 50, 100)]
    whole = m.zero()
    for _, tokens, sizes in op10.side_by_side(texts):
        total = m.expect(tokens, sizes, whole)
        for least in (1, 2, 7, 50, 99, 100):
            part = m.zero()
            assert m.expect(tokens, sizes, part, least) == pytest.approx(total)
            for a, b in ((whole.first, part.first), (whole.move, part.move), (whole.emit, part.emit)):
                assert np.allclose(a, b)


def test_scores_against_a_plain_recursion(spark, monkeypatch):
    """score of every row of a table by a model held fixed, against a loop over tokens with plain counts."""
    from collections import Counter
    from zlib import crc32

    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(30)], k=rng.randrange(0, 25))) + (f" only{i}" if i % 3 == 0 else "")) for i in range(60)] + [(60, None), (61, ""), (61, "")]
    fixed = []
    plain = op10.Hmm.start

    def start(share, states):
        fixed.append((plain(share, states), share))
        return fixed[-1][0]

    monkeypatch.setattr(op10.Hmm, "start", start)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = op10.score_documents(df, states=3, vocabulary=8, head=15, rounds=0, warm_docs=0).collect()
    (m, share), counts = fixed[0], Counter()
    for d, t in rows:
        if crc32(str(d).encode()) % 5 != 1:
            counts.update(op10.tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    uni = lambda w: (counts[w] + 0.5) / (n + 0.5 * (v + 1))
    least = sorted(counts.values(), reverse=True)[14]
    top = [w for w, c in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if c > least or c == least and sum(x >= least for x in counts.values()) <= 15][:8]
    want = {}
    for d, t in rows:
        a, s = None, 0.0
        for w in op10.tokens_of(t):
            k = top.index(w) if w in top else len(top)
            a = (m.first if a is None else a @ m.move) * m.emit[k]
            s += np.log10(a.sum()) + (0.0 if w in top else np.log10(uni(w)) - np.log10(share[len(top)]))
            a = a / a.sum()
        want[d] = s
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)


def test_start_is_made_from_every_training_text(spark):
    """Long texts, one of two words by turns and one of two others, that no bound on characters keeps out; pairs are those of all texts."""
    rows = [(2, "a b " * 15_000), (4, "c d " * 15_000)] + [(k, None) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = op10.score_documents(df, rounds=0).where("n_tokens > 1").collect()
    assert len(got) == 2 and all(r.score > 0.8 * r.base_score for r in got)
    texts, width = [[0, 1, 2, 9, 0], [9], [2, 2], []], op10._width(9)
    batch = pa.RecordBatch.from_arrays([pa.array([np.array(t, dtype=width).tobytes() for t in texts if t])], names=["ids"])
    found = {(p // 4, p % 4): c for b in op10._pairs(9, 3)(iter([batch])) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert found == {(0, 1): 1, (1, 2): 1, (2, 3): 1, (3, 0): 1, (2, 2): 1}


def test_model_beats_unigrams_on_held_out_text(spark, data):
    r = op10.op10_hidden_markov(spark, data).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_shard_files():
    rng = random.Random(3)
    keys = sorted(rng.randrange(-(10**6), 10**6) for _ in range(3000)) + [2 * 10**6] * 3
    values = [bytes(rng.randrange(256) for _ in range(2 * rng.randrange(40))) for _ in keys]
    out = io.BytesIO()
    w = op6.Writer(out)
    for k, v in zip(keys, values, strict=True):
        w.add(op6.key_of(k), v)
    assert w.close() == len(out.getvalue())
    r = op6.Reader(io.BytesIO(out.getvalue()))
    assert [(op6.id_of(k), v) for k, _, v in r.scan()] == list(zip(keys, values, strict=True)) and len(r.blocks) > 1
    for k in rng.sample(keys, 50) + [2 * 10**6]:
        assert r.get(op6.key_of(k)) == [v for x, v in zip(keys, values, strict=True) if x == k]
    absent = [k for k in range(3 * 10**6, 3 * 10**6 + 500)]
    assert all(r.get(op6.key_of(k)) == [] for k in absent) and sum(r.may_have(op6.key_of(k)) for k in absent) < 25
    bad = bytearray(out.getvalue())
    bad[10] ^= 1
    with pytest.raises(ValueError):
        list(op6.Reader(io.BytesIO(bytes(bad))).scan())
    with pytest.raises(ValueError):
        w.last = b"\2"
        w.add(b"\1", b"")


def test_compaction_plan():
    s = lambda n, b: op1.Shard(n, b, 1, 1)
    mb = 1 << 20
    due = op1.plan([s(f"a{i}", mb // 2) for i in range(5)] + [s(f"b{i}", 20 * mb) for i in range(4)] + [s("c", 5 * mb), s("d", 60 * mb)])
    assert [len(t) for t in due] == [5, 4]
    assert op1.tier_of(mb) == 1 and op1.tier_of(4 * mb) == 2 and op1.tier_of(mb - 1) == 0


def test_store_versions(spark, tmp_path):
    store = op1.ShardStore(spark, f"file://{tmp_path}/s")
    assert store.read() is None and store.versions() == []
    store.append(spark.range(10).repartition(4))
    store.append(spark.range(10, 20).repartition(3))
    store.compact()
    assert store.versions() == [1, 2, 3] and len(store.shards()) == 1
    assert store.read(1).count() == 10 and store.read().count() == 20
    with pytest.raises(op1.Conflict):
        store.commit([], 1)
    assert store.vacuum() == 7 and store.read().count() == 20
    store.append(none(spark).selectExpr("doc_id id"))
    assert store.read().count() == 20


def test_store_keeps_columns_that_come_later(spark, tmp_path):
    store = op1.ShardStore(spark, f"file://{tmp_path}/s")
    for k in range(3):
        store.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    store.append(spark.range(30, 40).selectExpr("id", "'x' extra", "id _batch0").coalesce(1))
    want = {(i, "x" if i >= 30 else None, i if i >= 30 else None) for i in range(40)}
    assert {tuple(r) for r in store.read().collect()} == want
    store.compact()
    store.vacuum()
    assert len(store.shards()) == 1 and {tuple(r) for r in store.read().collect()} == want
    with pytest.raises(ValueError, match="extra"):
        store.append(spark.range(1).selectExpr("id", "1 extra"))
    store.append(spark.range(40, 42).selectExpr("id", "cast(id % 2 as int) _batch0x"), "_batch0x")
    assert store.read().count() == 42


def test_compaction_goes_on_and_leaves_no_files(spark, tmp_path, monkeypatch):
    """A tier that no merge makes smaller does not keep later tiers from theirs; files of no version go after a grace time."""
    monkeypatch.setattr(op1, "LEAST", 2_000)
    store = op1.ShardStore(spark, f"file://{tmp_path}/s")
    for _ in range(4):
        store.append(spark.range(10).coalesce(1))
    for _ in range(4):
        store.append(spark.range(3000).selectExpr("id", "uuid() extra").coalesce(1))
    small = max(s.bytes for s in store.shards() if s.rows == 10)
    store.compact(target=4 * max(s.bytes for s in store.shards()))
    assert len(store.shards()) == 2 and small < 2_000 and store.read().count() == 12_040
    (tmp_path / "s/data/left").mkdir()
    (tmp_path / "s/data/left/part-0.parquet").write_bytes(b"x")
    store.vacuum()
    assert (tmp_path / "s/data/left/part-0.parquet").exists()
    store.vacuum(grace=-10)
    assert sorted(str(p) for p in (tmp_path / "s/data").rglob("*.parquet")) == sorted(s.path.replace("file:", "") for s in store.shards())


def test_winnowing_finds_long_enough_passages():
    rng = random.Random(1)
    for _ in range(50):
        h = [rng.randrange(50) for _ in range(30)]
        kept = op7.winnow(h)
        assert all(any(k <= p < k + op7.WINDOW for p in kept) for k in range(len(h) - op7.WINDOW + 1))


def test_segment_tree_against_plain_merges():
    """All widths, one by one and side by side, against a search for the lowest rank."""
    words = ["ab", "bc", "abc", "aa", "aaaa", "ca", "bca", "cab", "abab", "cc", "bb", "bbbb"]
    ranks = {bytes([i]): i for i in range(256)} | {w.encode(): 256 + i for i, w in enumerate(words)}
    bpe = op8.SegmentTreeBPE(ranks, r"\S+|\s+")
    rng = random.Random(6)
    pieces = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 65))).encode() for _ in range(300)]

    def merged(p):
        parts = [p[i : i + 1] for i in range(len(p))]
        while True:
            found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not found:
                return [ranks[x] for x in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    want = [merged(p) for p in pieces]
    assert bpe.merge_many(pieces) == want and [bpe.merge_one(p) for p in pieces] == want


def test_signatures_meet():
    """Linked sets share a signature, whatever is passed over, or both lack blocks; bitmaps never rule a link out."""
    rng = np.random.default_rng(2)
    met = 0
    for trial in range(600):
        n = int(rng.integers(1, 160))
        u = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        keep = u[rng.random(len(u)) > rng.random() * 0.25]
        v = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 6))).astype(np.uint64)]))
        if not len(v):
            continue
        inter = len(np.intersect1d(u, v))
        if 100 * inter < 75 * (len(u) + len(v) - inter):
            continue
        assert op9.most_common(op9.bitmap(u), op9.bitmap(v), len(u), len(v)) >= inter
        if len(u) == len(v) == inter:
            continue
        (x, lacks_u), (y, lacks_v) = op9.signatures(u), op9.signatures(v)
        assert np.intersect1d(x, y).size and not lacks_u and not lacks_v
        wide = np.sort(rng.choice(x, int(len(x) * (trial % 5) / 4), replace=False).view(np.uint64))
        (x, lacks_u), (y, lacks_v) = op9.signatures(u, wide), op9.signatures(v, wide)
        assert not np.isin(x.view(np.uint64), wide).any()
        assert np.intersect1d(x, y).size or lacks_u and lacks_v
        met += 1
    assert met > 200


def test_signatures_are_subsets_of_partitions():
    """A change to one partition of a block leaves exactly one of its three signatures."""
    u = np.sort(np.random.default_rng(5).integers(0, 2**64, 300, dtype=np.uint64))
    (_, blocks, need), *_ = op9.places(len(u))
    whole, _ = op9._subsets(u, blocks, 1, blocks, None)
    one, _ = op9._subsets(u[1:], blocks, 1, blocks, None)
    assert len(np.intersect1d(whole, one)) == len(whole) - 2 and need <= blocks


def test_sets_of_many_texts_cost_little_more_than_their_words():
    """Sets, bitmaps and signatures of texts, as tasks make them: the same as of each text by itself, in a bounded multiple of
    the CPU time that splitting them takes (about 10 to 15; 40 to 49 when each text went by itself)."""
    import random
    import time
    from types import SimpleNamespace

    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{int(rng.paretovariate(0.3)) % 10**7}" for _ in range(int(rng.paretovariate(1) * 60) % 2000)) for _ in range(1500)]
    texts[:8] = ["A b\x0bC\u00c9", "a B\tc\u00c9 ", None, " \n", "w" * 70 + " x", "W" * 70 + " X", "a\x00", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([0] * len(texts), pa.int64())], names=["doc_id", "text", "of_text"])
    words = [(t or "").encode() for t in texts]

    def cost(f):
        found = []
        for _ in range(3):
            began = time.process_time()
            out = f()
            found.append(time.process_time() - began)
        return min(found), out

    split, parts = cost(lambda: [t.lower().split() for t in words])
    described, told = cost(lambda: pa.Table.from_batches(op9._describe(iter([batch]))).to_pylist())
    signed, sigs = cost(lambda: pa.Table.from_batches(op9._sign(SimpleNamespace(value=None))(iter([batch]))).to_pylist())
    plain = [{tuple(p[k : k + 5]) for k in range(max(1, len(p) - 4))} if p else set() for p in parts]
    assert [r["n"] for r in told] == [len(p) for p in plain]
    first = {}
    assert [first.setdefault(r["node"], r["doc_id"]) for r in told] == [plain.index(p) for p in plain]
    of = {r["node"]: sorted(r["sigs"]) for r in sigs}
    assert of.keys() == {r["node"] for r in told if r["n"]}
    for r in told[:200]:
        (one,) = pa.Table.from_batches(op9._describe(iter([batch.slice(r["doc_id"], 1)]))).to_pylist()
        assert (one["n"], one["node"]) == (r["n"], r["node"])
        for alone in op9._sign(SimpleNamespace(value=None))(iter([batch.slice(r["doc_id"], 1)])):
            assert sorted(alone.column("sigs")[0].as_py()) == of[r["node"]]
    assert described + signed < 25 * split


def test_groups_of_any_size():
    """The rows of a group that goes on after its first part are members of the same group with the same pivot, however few."""
    import pyarrow as pa

    batch = lambda s, n: pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(n, pa.int64())], names=["sig", "node"])
    n = list(range(100))
    rows = [batch([5] * 60, n[:60]), batch([5] * 3 + [6, 6], [60, 61, 62, 1, 2]), batch([7] * 60, n[:60]), batch([7] * 2, [60, 61]), batch([8] * 60, n[:60]), batch([9, 9], [3, 4]), batch([10, 10], [3, 4])]
    got = [r for b in op9._gather(20, 50)(iter(rows)) for r in b.to_pylist()]
    members, pivots = {}, {}
    for r in got:
        members.setdefault(r["sig"], set()).update(r["members"])
        pivots.setdefault(r["sig"], set()).add(r["pivot"])
    assert members == {5: set(n[:63]), 6: {1, 2}, 7: set(n[:62]), 8: set(n[:60]), 9: {3, 4}}
    assert pivots == {5: {0}, 6: {1}, 7: {0}, 8: {0}, 9: {3}} and max(len(r["members"]) for r in got) <= 20


def test_cells_admit_every_linked_pair():
    """The bound over a cell, with sets of all sizes, against each pair; components and sides decide which pairs are looked at."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: int(k)], rng.integers(0, 2**64, int(rng.integers(0, 9)), dtype=np.uint64)])) for k in rng.integers(5, 400, 90)]
    linked = {(i, j) for i in range(90) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    node, n, c, bits = np.arange(90), np.array([len(u) for u in sets]), np.arange(90) % 7, [op9.bitmap(u) for u in sets]
    for side in (np.where(np.arange(90) % 3, 0, 1), np.where(np.arange(90) % 2, 2, 3)):
        found = {(max(p), min(p)) for a, b in op9._similar(side, node, c, n, bits) for p in zip(a.tolist(), b.tolist(), strict=True)}
        meet = lambda i, j: c[i] != c[j] and (side[i] + side[j] == 5 or sorted((side[i], side[j])) in ([0, 0], [0, 1]))  # noqa: B023, E731
        assert {p for p in linked if meet(*p)} <= found and all(meet(*p) for p in found)


def test_cells_give_few_pairs_of_two_components_at_first():
    """Crowds of near copies: the closest pairs of each two components, not all that the bound admits; two linked sets among them."""
    rng = np.random.default_rng(6)
    base, sets = rng.integers(0, 2**64, 300, dtype=np.uint64), []
    for k in range(120):
        gone = 15 if k % 3 else 60
        sets.append(np.unique(np.concatenate([base[rng.permutation(300)[gone:]], rng.integers(0, 2**64, gone // 5, dtype=np.uint64)])))
    node, n, c, bits = np.arange(120), np.array([len(u) for u in sets]), np.arange(120) % 4, [op9.bitmap(u) for u in sets]
    side = np.where(c, 0, 1)
    every = {p for a, b in op9._similar(side, node, c, n, bits) for p in zip(a.tolist(), b.tolist(), strict=True)}
    some = [p for a, b in op9._similar(side, node, c, n, bits, 2) for p in zip(a.tolist(), b.tolist(), strict=True)]
    of = {}
    for i, j in some:
        of.setdefault(frozenset((int(c[i]), int(c[j]))), []).append(100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])))
    assert len(every) > 1000 and set(some) <= every and len(of) == 6 and all(len(x) <= 2 and any(x) for x in of.values())


def test_bands_cover_neighbours():
    for (low, high), (nxt, _) in zip(op9.BANDS, op9.BANDS[1:], strict=False):
        assert nxt == high + 1
    for s in range(1, 3000):
        b = int(np.searchsorted(op9._TOPS, s))
        assert int(np.searchsorted(op9._TOPS, 4 * s // 3)) <= b + 1
