"""Personal data: fixed forms by patterns, and other ways of writing them by a linear-chain conditional random field.

Patterns find emails, ip addresses, card numbers and phone numbers in their usual forms (base_spans). The field finds them as
people write them to be read by people: `jane dot doe at mail dot example dot com`, `(310) 555-4510`, `4111.1111.1111.1111`,
`10[.]0[.]0[.]1`. Its sequences are the tokens (runs of letters, runs of digits, single signs) within REACH characters of a trigger on
one line, a trigger being a digit, an @, a `dot` or a bracketed `at`. A token is known by its shape: letter case, number of digits, which
sign, a word that announces data, and whether a space precedes it. The weights of the shapes from REACHED tokens before to as many after,
and those of label pairs, are trained on a small labelled table (labelled()) by maximum likelihood, in numpy; Viterbi decodes
sequences side by side. A decoded span counts if it holds what its kind needs (digits, checks, an at and a dot), so a text
without a trigger has none and is not decoded. A span of the field that meets one of the patterns goes.

Plan: one pass without exchange; the model is of fixed size and broadcast.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoders import slices

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9]+(?:[ -][0-9]+)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled, less 9 where that has two digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _octet(part: str) -> bool:
    x = part.lstrip("0")
    return len(x) < 3 or len(x) == 3 and x <= "255"


def _is_card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """The spans of the four patterns, leftmost and not overlapping within a kind, in order; in time linear in the text."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        # All characters before an @ that may stand there, as far back as the match before.
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, EMAIL, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[k : k + 4])) + 3
            if all(map(_octet, parts[k : k + 4])):
                out.append((at, IP, end))
            at = end + 1
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
        if _is_card(digits):
            out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


# The field.

REACH, REACHED = 60, 3
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_TRIGGER = re.compile(r"[0-9]+|@|\bdot\b|[\[({<] ?at ?[\])}>]", re.IGNORECASE)
_BRACKETED = tuple(f"{b}{gap}at" for b in "[({<" for gap in ("", " "))
#: Words that announce a kind of data.
CUES = {
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "whatsapp", "telefon", "tél", "teléfono"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "email": ("email", "mail", "contact", "write", "reach", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "ping", "router"),
    "com": ("com", "org", "net", "edu", "de", "fr", "es", "uk", "io"),
    "at": ("at",),
    "dot": ("dot",),
}
_CUE = {w: c for c, ws in CUES.items() for w in ws}
SIGNS = "@.-+()[]{}<>/:,;_#*\\"
_SHAPES = ["<pad>", "word", "Word", "WORD", "mixed", "sign", *CUES, *SIGNS, *(f"d{n}" for n in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 20))]
SHAPES = {s: k for k, s in enumerate([*_SHAPES, *(f"{s}~" for s in _SHAPES)])}
_LENGTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 20)


def shape(token: str) -> str:
    c = token[0]
    if "0" <= c <= "9":
        n = len(token)
        return f"d{max(x for x in _LENGTHS if x <= n)}"
    if not c.isalpha():
        return c if c in SIGNS else "sign"
    if (cue := _CUE.get(token.lower())) is not None:
        return cue
    return "word" if token.islower() else "Word" if token[1:].islower() else "WORD" if token.isupper() else "mixed"


LABELS = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]
_N = len(LABELS)
_NEVER = -1e4


def _allowed() -> np.ndarray:
    """(from, to), the last row for a start: the inside of a kind follows only its beginning or its inside."""
    ok = np.zeros((_N + 1, _N))
    for k in range(4):
        inside = 2 + 2 * k
        ok[:, inside] = _NEVER
        ok[[inside - 1, inside], inside] = 0
    return ok


@dataclass
class Field:
    """near (2 REACHED + 1, shapes, labels): weights of the shapes around a token; move (labels + 1, labels): of label pairs."""

    near: np.ndarray
    move: np.ndarray

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """(n, t, labels) of shape ids (n, t), which are 0 beyond a sequence's end."""
        n, t = ids.shape
        wide = np.zeros((n, t + 2 * REACHED), dtype=ids.dtype)
        wide[:, REACHED : REACHED + t] = ids
        return sum(w[wide[:, k : k + t]] for k, w in enumerate(self.near))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best labels (n, t) by Viterbi; sequences are sorted, longest first."""
        n, t = ids.shape
        e, move = self.scores(ids), self.move + _allowed()
        alive = np.searchsorted(-sizes, -np.arange(1, t + 1), side="right")
        back = np.zeros((t, n, _N), dtype=np.int8)
        best = e[:, 0] + move[-1]
        for k in range(1, t):
            m = int(alive[k])
            to = best[:m, :, None] + move[None, :-1]
            back[k, :m] = to.argmax(1)
            best[:m] = to.max(1) + e[:m, k]
        out = np.zeros((n, t), dtype=np.int8)
        at, rows = best.argmax(1), np.arange(n)
        for k in range(t - 1, -1, -1):
            m = int(alive[k])
            out[:m, k] = at[:m]
            at[:m] = back[k, rows[:m], at[:m]]
        return out


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(sequences: list[tuple[list[int], list[int]]], rounds: int = 120, rate: float = 0.15, weight: float = 1e-3) -> Field:
    """The field of (shape ids, labels) of each sequence: likelihood climbed by Adam, with a penalty on squared weights."""
    sequences = sorted((s for s in sequences if s[0]), key=lambda s: -len(s[0]))
    f = Field(np.zeros((2 * REACHED + 1, len(SHAPES), _N)), np.zeros((_N + 1, _N)))
    if not sequences:
        return f
    n, t, ok = len(sequences), len(sequences[0][0]), _allowed()
    ids, gold = np.zeros((n, t), dtype=np.int64), np.zeros((n, t), dtype=np.int64)
    for k, (x, y) in enumerate(sequences):
        ids[k, : len(x)], gold[k, : len(y)] = x, y
    sizes = np.array([len(x) for x, _ in sequences])
    there = np.arange(t)[None] < sizes[:, None]
    alive = there.sum(0)
    wide = np.zeros((n, t + 2 * REACHED), dtype=np.int64)
    wide[:, REACHED : REACHED + t] = ids
    shapes = [wide[:, k : k + t][there] for k in range(2 * REACHED + 1)]
    one = np.eye(_N)[gold] * there[:, :, None]
    pairs = np.zeros((_N + 1, _N))
    pairs[-1] = one[:, 0].sum(0)
    for k in range(1, t):
        pairs[:-1] += one[:, k - 1].T @ one[:, k]
    moments = [np.zeros_like(x) for x in (f.near, f.near, f.move, f.move)]
    for step in range(1, rounds + 1):
        e, move = f.scores(ids), f.move + ok
        a = np.full((t, n, _N), 0.0)
        a[0] = e[:, 0] + move[-1]
        for k in range(1, t):
            m = alive[k]
            a[k] = a[k - 1]
            a[k, :m] = _sum_exp(a[k - 1, :m, :, None] + move[None, :-1], 1) + e[:m, k]
        z = _sum_exp(a[-1], 1)
        b, seen, moved = np.zeros((n, _N)), np.zeros((n, t, _N)), np.zeros_like(pairs)
        for k in range(t - 1, -1, -1):
            m = alive[k]
            seen[:m, k] = np.exp(a[k, :m] + b[:m] - z[:m, None])
            if k:
                ahead = e[:m, k] + b[:m]
                joint = a[k - 1, :m, :, None] + move[None, :-1] + ahead[:, None, :] - z[:m, None, None]
                moved[:-1] += np.exp(joint).sum(0)
                b[:m] = _sum_exp(move[None, :-1] + ahead[:, None, :], 2)
        moved[-1] = seen[:, 0].sum(0)
        d = (one - seen)[there]
        near = np.stack([np.stack([np.bincount(s, d[:, y], minlength=len(SHAPES)) for y in range(_N)], 1) for s in shapes])
        for w, g, (m1, m2) in ((f.near, near / n - weight * f.near, moments[:2]), (f.move, (pairs - moved) / n - weight * f.move, moments[2:])):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            w += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return f


def tokens_of(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Shape ids and places of the tokens of one sequence."""
    ids, places, end = [], [], -1
    for m in _TOKEN.finditer(text):
        a, e = m.span()
        ids.append(SHAPES[shape(m[0]) + ("~" if a == end else "")])
        places.append((a, e))
        end = e
    return ids, places


def windows(text: str) -> Iterator[tuple[int, int]]:
    """What lies within REACH characters of a trigger on its line, as whole tokens; windows that meet are one."""
    low = text.lower()
    if not re.search("[0-9@]", text) and "dot" not in low and not any(x in low for x in _BRACKETED):
        return
    start = end = -1
    for m in _TRIGGER.finditer(text):
        a, e = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        a, line = text.rfind("\n", a, m.start()) + 1 or a, text.find("\n", m.end(), e)
        e = e if line < 0 else line
        if start < 0 or a > end:
            if start >= 0:
                yield start, end
            while a > end + 1 and text[a].isalnum() and text[a - 1].isalnum():
                a -= 1
            start = a
        if e > end:
            while e < len(text) and text[e].isalnum() and text[e - 1].isalnum():
                e += 1
            end = e
    if start >= 0:
        yield start, end


_AT_MARK = re.compile(r"@|\bat\b", re.IGNORECASE)
_DOT_MARK = re.compile(r"\.|\bdot\b", re.IGNORECASE)


def valid(kind: int, span: str) -> bool:
    """Whether a decoded span holds what its kind needs; a plain `at` counts only with a `dot`."""
    digits = re.sub("[^0-9]", "", span)
    if kind == EMAIL:
        marks = re.search(r"@|[\[({<] ?at ?[\])}>]", span, re.IGNORECASE)
        return bool(_DOT_MARK.search(span) if marks else _AT_MARK.search(span) and re.search(r"\bdot\b", span, re.IGNORECASE))
    if kind == IP:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(map(_octet, parts))
    if kind == CARD:
        return _is_card(digits)
    return 9 <= len(digits) <= 15


def _spans(text: str, start: int, places: list[tuple[int, int]], labels: list[int]) -> list[Span]:
    out, k = [], 0
    while k < len(labels):
        y = labels[k]
        if y % 2:  # a beginning
            j = k + 1
            while j < len(labels) and labels[j] == y + 1:
                j += 1
            a, e = start + places[k][0], start + places[j - 1][1]
            if valid((y - 1) // 2, text[a:e]):
                out.append((a, (y - 1) // 2, e))
            k = j
        else:
            k += 1
    return out


#: Tokens, with padding, that are decoded at once; sequences beyond it go alone.
DECODED = 200_000


def found_by(field: Field, texts: list[str]) -> list[list[Span]]:
    """The spans that the field finds in each text."""
    todo = [(i, a, *tokens_of(t[a:e])) for i, t in enumerate(texts) for a, e in windows(t)]
    todo = sorted((x for x in todo if x[2]), key=lambda x: -len(x[2]))
    out: list[list[Span]] = [[] for _ in texts]
    k = 0
    while k < len(todo):
        t = len(todo[k][2])
        part = todo[k : k + max(1, DECODED // t)]
        ids = np.zeros((len(part), t), dtype=np.int64)
        for r, x in enumerate(part):
            ids[r, : len(x[2])] = x[2]
        labels = field.decode(ids, np.array([len(x[2]) for x in part]))
        for (i, start, x, places), y in zip(part, labels, strict=True):
            out[i] += _spans(texts[i], start, places, y[: len(x)].tolist())
        k += len(part)
    return out


def all_spans(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, these and those of the field that meet none of them) of each text, in order."""
    out = []
    for t, more in zip(texts, found_by(field, texts), strict=True):
        base = base_spans(t)
        out.append((base, sorted([*base, *(x for x in more if all(x[2] <= a or e <= x[0] for a, _, e in base))])))
    return out


# The labelled table.

#: {email} and the like stand for data of that kind. Lines without any teach what is none.
TEMPLATES = (
    "write to {email} for details", "contact: {email}", "you can reach me under {email} , thanks .", "my address is {email} and not the old one",
    "{email}", "mail {email} or call {phone}", "send it ( {email} ) please", "the author , {email} , wrote this", "The was of {email} and onth erti thly",
    "call {phone} now", "phone {phone}", "tel : {phone} , fax : {phone}", "{phone}", "my number is {phone} .", "Thnd erly onre {phone} thion of the", "office {phone} ext 12", "mobile {phone} or {email}",
    "card {card} expires 12/27", "paid with visa {card}", "{card}", "number {card} on the card", "At er ndion {card} thesh of",
    "ping {ip} from the host", "server at {ip} is down", "{ip}", "the ip is {ip} , port 8080", "ndon th {ip} eron thly and",
    "on 2024-01-31 at 12:30 we met", "it costs $ 1,234.56 or 1 200 EUR", "version 1.2.3 of 2019", "see pages 12 - 340 and 1990-1995", "ISBN 978-3-16-148410-0", "order 20231109-1234567 has 3 items",
    "we met at noon on the dot", "the dot com bubble at its height in 2000", "look at the dot at the end", "12 of 340 , 5.5 % at 3.7 km", "in 1848 , 1849 and 1850 there were 1000000 people",
    "section 3.2.1.4 of the act", "at 10.30 or 11.45", "INV-2023-000123 and 0000 0000", "1. first 2. second 3. third", "score 3-2 at half time , 105-99 at the end", "the ratio 1 : 2 : 3 : 4",
    "Thndti the 0. onan, at thon 12 as", "she stood at the door and the dot on the map", "at 5 dot 3 we stop", "add 1 2 3 4 5 6 7 8 9 10", "room 310 , floor 5 , seat 45", "3.14159265358979 is pi", "call me at noon", "the card has 4 sides and 52 cards", "x = a [ 1 ] + b ( 2 )",
    "temperatures of 10 - 15 - 20 degrees", "serial 4381893557741601 of the machine", "phone model 3310 from 2000", "the server has 16 cores and 128 GB",
)
_NAMES = ("jane", "john.doe", "m.smith", "info", "sales", "ana", "Pierre", "k.mueller", "bob_42", "user19", "hein.19")
_HOSTS = ("example", "mail", "acme", "gmail", "uni-bonn", "mail5.example", "beispiel", "correo")
_ENDS = ("com", "org", "net", "de", "fr", "es", "edu")


def _email(r: random.Random) -> str:
    name, host, end = r.choice(_NAMES), r.choice(_HOSTS), r.choice(_ENDS)
    at, dot = r.choice((("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" AT ", " DOT "), (" @ ", " . "), (" @ ", "."), (" [at] ", "."), (" {at} ", " {dot} ")))
    if "ot" in dot.lower():
        name, host = name.replace(".", dot), host.replace(".", dot)
    return f"{name}{at}{host}{dot}{end}"


def _phone(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+49 {d(3)} {d(7)}", f"0{d(3)}/{d(7)}", f"0{d(3)} {d(7)}", f"00{d(2)} {d(3)} {d(7)}", f"+{d(2)}-{d(3)}-{d(3)}-{d(4)}"))


def _card(r: random.Random) -> str:
    x = "4" + "".join(r.choice("0123456789") for _ in range(14))
    x += next(c for c in "0123456789" if luhn(x + c))
    gap = r.choice(("", " ", "-", ".", "_", " / ", " . "))
    return gap.join(x[k : k + 4] for k in range(0, 16, 4))


def _ip(r: random.Random) -> str:
    return r.choice((".", "[.]", " . ", " dot ", "[dot]", "(.)", " [.] ")).join(str(r.randrange(256)) for _ in range(4))


#: Lines of the labelled table for each template; and a bound on the lines of any that a field is trained on.
EACH, MOST_LINES, SEED = 8, 5_000, 11


def labelled(spark: SparkSession, each: int = EACH, seed: int = SEED) -> DataFrame:
    """(line, spans): the labelled table that is used where there is no other; spans are (kind, from, to) in characters."""
    r, rows = random.Random(seed), []
    make = {"email": _email, "phone": _phone, "card": _card, "ip": _ip}
    for template in TEMPLATES:
        for _ in range(each):
            line, spans = "", []
            for k, part in enumerate(re.split(r"\{(\w+)\}", template)):
                if k % 2:
                    data = make[part](r)
                    spans.append((part, len(line), len(line) + len(data)))
                    part = data
                line += part
            rows.append((line, spans))
    return spark.createDataFrame(rows, "line string, spans array<struct<kind:string,from:int,to:int>>")


def fit(table: DataFrame, most: int = MOST_LINES) -> Field:
    """The field of a labelled table (line, spans), of which it takes `most` lines at most; other columns are not looked at. Lines
    that are null, and spans of other kinds, teach nothing; with no line at all the field finds nothing."""
    sequences = []
    for line, spans in table.select("line", "spans").where("line is not null").orderBy(F.xxhash64("line"), "line").limit(most).collect():
        ids, places = tokens_of(line)
        labels = [0] * len(ids)
        for kind, a, e in spans or []:
            inside = [k for k, (x, y) in enumerate(places) if a <= x and y <= e] if kind in KINDS else []
            for k in inside:
                labels[k] = 2 * KINDS.index(kind) + 1 + (k != inside[0])
        sequences.append((ids, labels))
    return train(sequences)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in slices(batches, rows=1024, chars=8_000_000):
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows = []
            for base, every in all_spans(field, texts):
                n = [sum(1 for x in base if x[1] == k) for k in range(4)]
                rows.append((*n, len(every) - len(base), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def find(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (spans of the patterns), n_added (of the field),
    base_sha256, spans.

    docs needs doc_id and text; other columns are not looked at. A null or empty text has no spans. Spans of different kinds may
    overlap where patterns do; offsets are in code points. Repeated rows have a row each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    field = spark.sparkContext.broadcast(fit(labelled(spark) if table is None else table))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(field), FOUND)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_pii": op12_pii}
SQL: dict[str, str] = {}
