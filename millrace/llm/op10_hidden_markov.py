"""Scoring texts by a hidden Markov language model.

Tokens: words of A-Z lowered, then one end. The VOCABULARY most frequent training tokens have emissions of their own in each
of STATES latent states; all others share one class, within which a token has its share of the smoothed unigram
probability (all unseen ones together are one type), so that the model is a distribution over all token sequences.

Each document is coded once: the numbers of its tokens go to a table that all passes below read.

Training: Baum-Welch, from all training documents. The start comes from how often each of the PAIRED most frequent tokens (the others
as one) follows each, in every training document: a table of bounded size, to which rounds of the same method fit a pair of neighbouring states. Each of
ROUNDS rounds then runs scaled forward and backward recursions over every training document and sums the expected counts over
partitions. Scoring: scaled forward recursion over whole texts, exact. Documents of like length go through the recursions side by side.

Unigram counts cover all training tokens and grow with the corpus, so they stay a distributed table. The HEAD most
frequent tokens (a bound on what is broadcast) are looked up in the scoring pass; the others, of which no one is hot, go
through a join: a document's distinct tail tokens meet the counts by token, and sums return by document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle
from .encoders import slices

STATES, VOCABULARY, HEAD, ROUNDS = 6, 8_192, 200_000, 3
#: Of the start: tokens with pairs of their own, rounds over the table of pairs, and how many starts are made, of which the likeliest one counts.
PAIRED, PAIR_ROUNDS, STARTS, SEED = 512, 600, 4, 7
END = b"\n"
#: Documents side by side: as many as have so many tokens, with their padding.
BATCH_TOKENS, BATCH_DOCS, COUNTED = 300_000, 512, 400_000
#: Weighted tokens that are counted at once.
WEIGHED = 1 << 16
#: Steps of a text whose forward variables are kept at once, at least.
STRETCH = 4_096


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def tokens_of(text: str | None) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(END)
    return words


class _Ids(dict):
    def __missing__(self, key):
        return -1


@dataclass
class Hmm:
    """first (k), move (k, k), emit (v, k): probabilities; the last row of emit is the class of all other tokens."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, states: int, seed: int = SEED) -> Hmm:
        """The unigram shares, stirred, in each state."""
        r = np.random.default_rng(seed)
        emit = share[:, None] * np.exp(r.normal(0, 0.7, (len(share), states)))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    def forward(self, tokens: np.ndarray, sizes: np.ndarray, stretch: int = 0):
        """log likelihood of each row of tokens (n, t); rows are padded at their ends and sorted, longest first. With
        stretch, also the scaled forward variables (states, rows) before each stretch of so many steps, and all of the last stretch, the
        scales of each step and how many rows reach it."""
        n, t = tokens.shape
        alive = np.searchsorted(-sizes, -np.arange(1, t + 1), side="right")  # rows that have a token at each step
        columns, emit, move = *self._by_step(tokens), np.ascontiguousarray(self.move.T)
        a, before, last, scales = None, [], [], np.ones((t, n))
        for k in range(t):
            if stretch and k % stretch == 0:
                before.append(a)
            m = int(alive[k])
            a, scales[k, :m] = self._step(a, columns[k, :m], emit, move)
            if stretch and k >= (t - 1) // stretch * stretch:
                last.append(a)
        out = np.log(scales).sum(0)
        return (out, before, last, scales, alive) if stretch else out

    def _by_step(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each step, and the emissions of each state, side by side in memory."""
        return np.ascontiguousarray(tokens.T), np.ascontiguousarray(self.emit.T)

    def _step(self, a: np.ndarray | None, tokens: np.ndarray, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = emit.take(tokens, axis=1)
        e *= self.first[:, None] if a is None else move @ a[:, : len(tokens)]
        s = e.sum(0)
        e /= s
        return e, s

    def expect(self, tokens: np.ndarray, sizes: np.ndarray, into: Hmm, least: int = STRETCH) -> float:
        """Add the expected counts of one batch; its log likelihood. The forward variables of a long text are not all kept:
        on the way back each stretch of its steps, about the root of their number, is computed again."""
        t = tokens.shape[1]
        stretch = max(least, math.isqrt(t))
        out, befores, a, scales, alive = self.forward(tokens, sizes, stretch)
        columns, emit, move = *self._by_step(tokens), np.ascontiguousarray(self.move.T)
        b, end, moved = np.ones((len(self.first), int(alive[-1]))), t, np.zeros_like(self.move)
        seen, weights, held = [], [], 0
        while befores:
            before, start = befores.pop(), len(befores) * stretch
            if end < t:
                a, x = [], before
                for k in range(start, end):
                    x, _ = self._step(x, columns[k, : int(alive[k])], emit, move)
                    a.append(x)
            for k in range(end - 1, start - 1, -1):
                m = int(alive[k])
                if b.shape[1] < m:
                    b = np.concatenate([b, np.ones((len(b), m - b.shape[1]))], axis=1)
                seen.append(columns[k, :m])
                weights.append(a[k - start] * b)
                held += m
                if k:
                    e = emit.take(seen[-1], axis=1)
                    e *= b
                    e /= scales[k, :m]
                    moved += (a[k - start - 1] if k > start else before)[:, :m] @ e.T
                    b = self.move @ e
                else:
                    into.first += weights[-1].sum(1)
                if held >= WEIGHED or not k:
                    numbers, shares = np.concatenate(seen), np.concatenate(weights, axis=1)
                    for i in range(len(self.first)):
                        into.emit[:, i] += np.bincount(numbers, shares[i], minlength=len(into.emit))
                    seen, weights, held = [], [], 0
            end = start
        into.move += self.move * moved
        return float(out.sum())

    def zero(self) -> Hmm:
        return Hmm(*(np.zeros_like(x) for x in (self.first, self.move, self.emit)))

    def improved(self, counts: Hmm, share: np.ndarray) -> Hmm:
        """The next parameters, from expected counts and a little of the unigram shares."""
        first, move, emit = counts.first + 0.1, counts.move + 0.1, counts.emit + share[:, None]
        return Hmm(first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def side_by_side(ids: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of documents, tokens padded to one length, lengths), longest first."""
    order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
    k = 0
    while k < len(order):
        t = len(ids[order[k]])
        part = order[k : k + max(1, min(BATCH_DOCS, BATCH_TOKENS // t))]
        tokens = np.zeros((len(part), t), dtype=np.int64)
        for r, i in enumerate(part):
            tokens[r, : len(ids[i])] = ids[i]
        yield np.array(part), tokens, np.array([len(ids[i]) for i in part])
        k += len(part)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "c"])
        counts.clear()
        return batch

    for b in slices(batches):
        for t in b.column("text").to_pylist():
            counts.update(tokens_of(t))
        if len(counts) > COUNTED:
            yield out()
    if counts:
        yield out()


CODED = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, rare_logs double, n_rare long, tail array<struct<token:binary,n:int>>, ids binary"


def _code(shared, v: int):
    """A document's tokens as numbers (v: without emissions of their own), what the head says of them, and the tokens it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, logs = shared.value
        row = TaskContext.get().partitionId() << 36
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int32())])), pa.binary())
        for b in slices(batches, rows=2048, chars=16_000_000):
            out = []
            for d, held, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                words = tokens_of(t)
                ids = list(map(known.__getitem__, words))
                x = np.array(ids, dtype=np.int64)
                tail = Counter(w for w, i in zip(words, ids, strict=True) if i < 0) if (lacks := int((x < 0).sum())) else {}
                rare = x[x >= v]
                out.append((row, d, held, len(x), len(x) - lacks, float(logs[x[x >= 0]].sum()), float(logs[rare].sum()), len(rare) + lacks, [{"token": w, "n": n} for w, n in tail.items()], np.where((x >= 0) & (x < v), x, v).astype(_width(v)).tobytes()))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CODED.split(", ")])

    return run


def _width(v: int) -> type:
    return np.uint16 if v < 1 << 16 else np.uint32


def _ids_of(b: pa.RecordBatch, v: int) -> list[np.ndarray]:
    return [np.frombuffer(x, _width(v)) for x in b.column("ids").to_pylist()]


def _pairs(v: int, paired: int):
    """How often each of the most frequent tokens follows each; pair: the first one's number times paired + 1, and the second one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((paired + 1) ** 2, dtype=np.int64)
        for b in slices(batches, rows=2048, chars=4_000_000, column="ids"):
            ids = _ids_of(b, v)
            x = np.minimum(np.concatenate(ids).astype(np.int64), paired)
            inside = np.ones(len(x), dtype=bool)
            inside[np.cumsum([len(i) for i in ids]) - 1] = False  # nothing follows a document's last token
            counts += np.bincount(x[:-1][inside[:-1]] * (paired + 1) + x[1:][inside[:-1]], minlength=len(counts))
        found = np.flatnonzero(counts)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found])], names=["pair", "c"])

    return run


def _fit_pairs(counts: np.ndarray, share: np.ndarray, states: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood, joint probabilities of two neighbouring states, emissions), fitted to the counts of pairs."""
    start = Hmm.start(share, states, seed)
    emit, both, likely = start.emit, start.move / states, 0.0
    for _ in range(PAIR_ROUNDS):
        p = emit @ both @ emit.T
        likely = float((counts * np.log(p)).sum())
        r = counts / p
        second, first = r @ emit, r.T @ emit
        both, emit = both * (emit.T @ second), emit * (second @ both.T + first @ both) + 0.1 * share[:, None]
        both, emit = both / both.sum(), emit / emit.sum(0)
    return likely, both, emit


def _start(shared, states: int, paired: int):
    """The start from the counts of pairs, in one task; tokens without pairs of their own have their shares of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, counts = shared.value, np.zeros((paired + 1) ** 2)
        for b in batches:
            counts[b.column("pair").to_numpy()] = b.column("c").to_numpy()
        table, rest = counts.reshape(paired + 1, paired + 1), share[paired:]
        fits = (_fit_pairs(table, np.append(share[:paired], rest.sum()), states, SEED + k) for k in range(STARTS))
        _, both, emit = max(fits, key=lambda x: x[0])
        emit = np.concatenate([emit[:paired], rest[:, None] / rest.sum() * emit[paired]])
        yield _rows(Hmm(both.sum(1), both / both.sum(1, keepdims=True), emit), states)

    return run


def _rows(m: Hmm, states: int) -> pa.RecordBatch:
    """id: a token; below 0, a state's moves; the start comes last."""
    ids = np.concatenate([np.arange(len(m.emit)), -1 - np.arange(states), [-1 - states]])
    all_ = np.concatenate([m.emit, m.move, m.first[None, :]])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array(all_[:, k]) for k in range(states))], names=["id", *(f"s{k}" for k in range(states))])


def _model(rows: list, v: int, states: int) -> Hmm:
    m = Hmm(np.zeros(states), np.zeros((states, states)), np.zeros((v + 1, states)))
    for r in rows:
        x = np.array(r[1:])
        if r[0] >= 0:
            m.emit[r[0]] = x
        elif r[0] >= -states:
            m.move[-1 - r[0]] = x
        else:
            m.first = x
    return m


def _expect(shared, v: int, states: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, some = shared.value, False
        into = model.zero()
        for b in slices(batches, rows=2048, chars=4_000_000, column="ids"):
            for _, tokens, sizes in side_by_side(_ids_of(b, v)):
                model.expect(tokens, sizes, into)
                some = True
        if some:
            yield _rows(into, states)

    return run


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, rare_logs double, n_rare long, path double"


def _score(shared, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, rows=2048, chars=4_000_000, column="ids"):
            path = np.zeros(b.num_rows)
            for numbers, tokens, sizes in side_by_side(_ids_of(b, v)):
                path[numbers] = model.forward(tokens, sizes) / np.log(10)
            names = [x.split()[0] for x in SCORED.split(", ")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(path)], names=names)

    return run


def _head(counts: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], int]:
    """(the most frequent tokens, as many as asked for or all there are, with their counts; the least count among them). It takes a
    table of how many tokens have each count, and of those that have the least one as many as there is room for, by their bytes."""
    n, least = 0, 0
    for c, k in sorted(map(tuple, counts.groupBy("c").count().collect()), reverse=True):
        n, least = n + k, c
        if n >= most:
            break
    rows = [(bytes(r[0]), r[1]) for r in counts.where(F.col("c") > least).select("token", "c").collect()]
    rows += [(bytes(r[0]), least) for r in counts.where(F.col("c") == least).select("token").orderBy("token").limit(most - len(rows)).collect()]
    return sorted(rows, key=lambda x: (-x[1], x[0])), least


def score_documents(docs: DataFrame, states: int = STATES, vocabulary: int = VOCABULARY, head: int = HEAD, rounds: int = ROUNDS, warm_docs: int | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs needs doc_id and text; other columns are not looked at. A null or empty text is one end; a row without doc_id is
    learned from. Repeated rows count, and are scored, each. With nothing to learn from, every token is unseen. An empty
    table gives an empty result. warm_docs: 0 leaves out the start from pairs; with any other value it is of all training documents.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    train = docs.where("not held_out")
    counts = settle(train.select("text").mapInArrow(_count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "unigrams")
    n, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    whole = n + 0.5 * (v_all + 1)
    top, least = _head(counts, head)
    known = _Ids({w: i for i, (w, _) in enumerate(top)})
    c = np.array([x[1] for x in top], dtype=np.float64)
    v = min(vocabulary, len(top))
    share = np.append((c[:v] + 0.5) / whole, 0.0)
    share[v] = max(1 - share[:v].sum(), 0.5 / whole)
    coded = settle(docs.mapInArrow(_code(sc.broadcast((known, np.log10(c + 0.5))), v), CODED), "coded")
    learned = coded.where("not held_out").select("ids")

    shape = "id int, " + ", ".join(f"s{k} double" for k in range(states))
    model, paired = Hmm.start(share, states), min(PAIRED, v)
    if top and warm_docs != 0:
        pairs = learned.mapInArrow(_pairs(v, paired), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
        model = _model(pairs.repartition(1).mapInArrow(_start(sc.broadcast(share), states, paired), shape).collect(), v, states)
    for _ in range(rounds if top else 0):
        step = learned.mapInArrow(_expect(sc.broadcast(model), v, states), shape).groupBy("id").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states)))
        model = model.improved(_model(step.collect(), v, states), share)

    scored = coded.drop("tail").mapInArrow(_score(sc.broadcast(model), v), SCORED)
    tail = coded.select("row", F.explode("tail").alias("e")).select("row", "e.token", "e.n")
    rare = counts.where(F.col("c") <= least).select("token", "c") if len(top) < v_all else counts.limit(0)  # what the head lacks
    tail = tail.join(rare, "token", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("t_logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("t_known"))
    rows, more = scored.join(tail, "row", "left"), F.coalesce("t_logs", F.lit(0.0))
    per = float(np.log10(whole))
    return rows.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("t_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * per).alias("base_score"),
        (F.col("path") + F.col("rare_logs") + more - F.col("n_rare") * (per + float(np.log10(share[v])))).alias("score"),
    )


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those not held out."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_hidden_markov": op10_hidden_markov}
SQL: dict[str, str] = {}
