"""Encoding whole texts with public tokenizers, each distinct piece or space-separated chunk only once in a worker."""

from __future__ import annotations

import contextlib
import json
import os
import re
import string
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Characters that some pattern dialects take for white space.
EDGES = "\u180e\u200b\ufeff"
#: Bytes that a memo holds, about, with what a piece costs besides its characters and ids; characters of the longest piece in it. A chunk counts as a piece.
MEMO, EACH, LONG = 200_000_000, 180, 64

NEW = 0


class _Known(dict):
    """Ids of a chunk; None if it has to be encoded with its text; NEW if it has not been met."""

    def __missing__(self, chunk: str) -> int:
        return NEW


class ChunkMemo:
    """Ids of texts, put together from the ids of their chunks between single spaces.

    A pattern that splits text before the merges lets a space go only with what follows it, so a chunk's ids do not
    depend on its neighbours as long as no run of white space reaches over a space. Texts with such runs (spaced,
    below) are encoded as a whole. Memory: about `memo` bytes of chunks
    and their ids are remembered; chunks above LONG characters (texts without spaces) are not.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], spaced: bool, memo: int = MEMO):
        self.encode, self.spaced, self.memo, self.known, self.held = encode, spaced, memo, _Known(), 0

    def _plain(self, chunk: str) -> bool:
        return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace() and chunk[0] not in EDGES and chunk[-1] not in EDGES

    def texts(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        split = [t.split(" ") for t in texts]
        heads: list[str | None] = [None] * len(texts)
        if self.spaced:  # the first chunk has no space before it
            for k, parts in enumerate(split):
                heads[k], split[k] = parts[0], parts[1:]
        if self.held > self.memo:
            self.known.clear()
            self.held = 0
        chunks = list(set().union(*split))
        here = dict(zip(chunks, map(self.known.__getitem__, chunks), strict=True))
        here.update(self._learn([c for c, ids in here.items() if ids is NEW]))
        lone = sorted({h for h in heads if h and self._plain(h)})
        first = dict(zip(lone, self.encode(lone), strict=True)) if lone else {}
        out, whole = [b""] * len(texts), []
        for k, parts in enumerate(split):
            if self.spaced and not parts and not heads[k]:
                continue
            if self.spaced and heads[k] not in first:
                whole.append(k)
                continue
            try:
                ids = b"".join(map(here.__getitem__, parts))
            except TypeError:  # None: a chunk that has to be encoded with its text
                whole.append(k)
            else:
                out[k] = first[heads[k]] + ids if self.spaced else ids
        if whole:
            for k, ids in zip(whole, self.encode([texts[k] for k in whole]), strict=True):
                out[k] = ids
        return out

    def _learn(self, fresh: list[str]) -> dict[str, bytes | None]:
        """Ids of chunks that have not been met. Remembered but for long ones."""
        lead = " " if self.spaced else ""
        found: dict[str, bytes | None] = {}
        todo = []
        for c in fresh:
            if self.spaced and not self._plain(c):
                found[c] = None
            elif c:
                todo.append(c)
            else:
                found[c] = b""
        for k in range(0, len(todo), 20_000):
            part = todo[k : k + 20_000]
            found.update(zip(part, self.encode([lead + c for c in part]), strict=True))
        kept = {c: ids for c, ids in found.items() if len(c) <= LONG}
        self.known.update(kept)
        self.held += EACH * len(kept) + sum(map(len, kept)) + sum(len(ids) for ids in kept.values() if ids)
        return found


#: Kinds of bytes. Odd: controls, white space and EDGES beyond ASCII. Other: the rest beyond ASCII but for Latin letters from U+00C0 to U+00FF.
ODD, OTHER, LETTER, DIGIT, MARK, QUOTE, BLANK, LINE = range(8)
SOLID = (OTHER, LETTER, DIGIT, MARK, QUOTE)
_KIND = np.zeros(256, np.uint8)
_KIND[0x80:] = OTHER
for _kind, _of in ((LETTER, string.ascii_letters), (DIGIT, string.digits), (MARK, string.punctuation), (QUOTE, "'"), (BLANK, " \t\x0b\x0c\r"), (LINE, "\n")):
    _KIND[list(_of.encode())] = _kind
_SOLID = np.isin(np.arange(8), SOLID)
#: Whether text is cut between bytes of two kinds (8 * first + second).
_CUT = np.zeros(64, bool)
_CUT[[8 * a + b for a in SOLID for b in (BLANK, LINE)]] = True
_CUT[[8 * a + b for a in (LETTER, DIGIT, MARK) for b in (LETTER, DIGIT, MARK, QUOTE) if a != b and (a, b) != (MARK, QUOTE)]] = True


def _code(c: str) -> int:
    return int.from_bytes(c.encode().ljust(3, b"\0"), "big")


_ODD_CODES = np.array(sorted(_code(c) for c in [*filter(str.isspace, map(chr, range(0x80, 0x3001))), *EDGES]), np.uint32)
_ODD_LEADS = np.isin(np.arange(256), _ODD_CODES >> 16)


def _kinds(raw: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8."""
    kinds = _KIND[raw]
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        first = raw[lead]
        latin = lead[first == 0xC3]
        latin = latin[(raw[latin + 1] & 0x9F) != 0x97]  # no letters: U+00D7, U+00F7
        kinds[latin] = kinds[latin + 1] = LETTER
        wide = lead[_ODD_LEADS[first]]
        long = raw[wide] >= 0xE0
        code = raw[wide].astype(np.uint32) << 16 | raw[wide + 1].astype(np.uint32) << 8 | np.where(long, raw[np.minimum(wide + 2, len(raw) - 1)], 0)
        odd = np.isin(code, _ODD_CODES)
        wide, long = wide[odd], long[odd]
        kinds[wide] = kinds[wide + 1] = ODD
        kinds[wide[long] + 2] = ODD
    return kinds


def cuts(raw: np.ndarray) -> np.ndarray:
    """Whether text may be cut before each byte of UTF-8, so that the ids of the pieces, one after another, are those of the text.

    For patterns that hold runs of letters, of digits and of other characters apart, but for an apostrophe and what
    follows it, and where white space goes only with what follows: before white space that begins, where letters,
    digits and marks meet, and after a single end of line.
    """
    kinds, out = _kinds(raw), np.zeros(len(raw), bool)
    np.take(_CUT, kinds[:-1] << 3 | kinds[1:], out=out[1:])
    line = np.flatnonzero(kinds[1:-1] == LINE) + 1
    out[line[_SOLID[kinds[line - 1]] & _SOLID[kinds[line + 1]]] + 1] = True
    return out


class PieceMemo:
    """Ids of texts, put together from the ids of their pieces between cuts().

    Arrow finds the distinct pieces of a batch; each is looked up once, and its ids are dealt to all its places. Texts that
    hold an added token of the tokenizer are encoded as a whole, and all texts are if no way to encode words is given.
    Memory: about `memo` bytes of pieces and their ids are remembered; pieces above LONG characters (long runs beyond
    Latin letters) are not.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], memo: int = MEMO, letters: Callable[..., list[bytes]] | None = None, added: re.Pattern | None = None):
        """letters: a way to encode many words of Latin letters at once, each as it is with its space before it, or (True) without. added: finds added tokens."""
        self.encode, self.memo, self.known, self.letters, self.added, self.held = encode, memo, {}, letters, added, 0

    def texts(self, texts: list[str] | pa.Array) -> list[bytes]:
        """For each text (null: empty) its ids, as little-endian unsigned 32-bit integers."""
        column = (pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())).fill_null("")
        if not self.letters:
            return self.encode(column.to_pylist())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        size = int(bounds[-1] - bounds[0]) if len(column) else 0
        if not size:
            return [b""] * len(column)
        raw = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cut = cuts(raw)
        cut[bounds[bounds < size]] = True
        starts = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, size)), pa.py_buffer(raw)).dictionary_encode()
        ids = pa.array(self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(starts, bounds)].tolist()
        flat = memoryview(ids.buffers()[2] or b"")
        out = [flat[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
        if self.added:
            whole = [(k, t) for k, t in enumerate(column.to_pylist()) if self.added.search(t)]
            for (k, _), x in zip(whole, self.encode([t for _, t in whole]), strict=True):
                out[k] = x
        return out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if self.held > self.memo:
            self.known.clear()
            self.held = 0
        ids = list(map(self.known.get, pieces))
        found = self._learn([p for p, x in zip(pieces, ids, strict=True) if x is None])
        return [found[p] if x is None else x for p, x in zip(pieces, ids, strict=True)]

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids of pieces that have not been met. Remembered but for long ones."""
        words, bare = list(filter(_WORD, fresh)), list(filter(_BARE, fresh))
        found = dict(zip(words, self.letters([w[1:] for w in words]), strict=True))
        found.update(zip(bare, self.letters(bare, True), strict=True))
        rest = [p for p in fresh if p not in found]
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            found.update(zip(part, self.encode(part), strict=True))
        kept = {p: x for p, x in found.items() if len(p) <= LONG}
        self.known.update(kept)
        self.held += EACH * len(kept) + sum(map(len, kept)) + sum(map(len, kept.values()))
        return found


#: A word of Latin letters with a space before it, or without.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORD, _BARE = re.compile(f" [{_LATIN}]+").fullmatch, re.compile(f"[{_LATIN}]+").fullmatch

#: What cuts() and lines of words are right for: how a tokenizer file normalizes and splits, by whether words keep the space before them.
_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KEPT = (None, [("ByteLevel", None, True)])
_DROPPED = ([("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)], [("Split", _APART, None), ("ByteLevel", None, False)])


def _known_split(path: str, spaced: bool) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec["normalizer"], spec["pre_tokenizer"] or {"type": ""}
    norm = norm and [(x["type"], x.get("pattern", {}).get("Regex")) for x in norm.get("normalizers", [norm])]
    pre = pre.get("pretokenizers", [pre])
    if spec["truncation"] or spec["padding"] or spec["model"]["type"] != "BPE" or any(x.get("add_prefix_space") for x in pre):
        return False
    return (norm, [(x["type"], x.get("pattern", {}).get("Regex"), x.get("use_regex")) for x in pre]) == (_KEPT if spaced else _DROPPED)


def library_encoder(path: str, spaced: bool) -> PieceMemo:
    """The tokenizer file at path, by the tokenizers library: nothing is added; strings of its own added tokens are those tokens.

    spaced: whether a word's token holds the space before it. Files that split in another way than _KEPT and _DROPPED encode whole texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in t.encode_batch_fast(texts, add_special_tokens=False)]

    if not _known_split(path, spaced):
        return PieceMemo(encode)
    names = [re.escape(x.content) for x in t.get_added_tokens_decoder().values()]
    added = re.compile("|".join(names), re.IGNORECASE) if names else None
    # In a line of words, a word's first token holds its space, or its last token the mark of a word's end.
    mark = np.zeros(t.get_vocab_size() + 1, dtype=bool)
    for token, i in t.get_vocab().items():
        mark[i] = token.startswith("\u0120") if spaced else token.endswith("</w>")

    end_of_line = encode(["\n"])[0]

    def letters(words: list[str], bare: bool = False, line: int = 200) -> list[bytes]:
        out: list[bytes] = []
        lines = [words[k : k + line] for k in range(0, len(words), line)]
        if bare and spaced:
            if len(end_of_line) != 4:
                return encode(words)
            (end,) = np.frombuffer(end_of_line, "<u4")
            for part, raw in zip(lines, encode(["\n".join(x) for x in lines]), strict=True):
                at = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == end)).tolist()
                if len(at) + 1 == len(part):
                    out += [raw[a:b] for a, b in zip([0, *(x + 4 for x in at)], [*at, len(raw)], strict=True)]
                else:
                    out += encode(part)
            return out
        for part, raw in zip(lines, encode([(" " if spaced else "") + " ".join(x) for x in lines]), strict=True):
            at = np.flatnonzero(mark[np.frombuffer(raw, "<u4")])
            ends = np.append(at[1:], len(raw) // 4) if spaced else at + 1
            if len(ends) != len(part):
                out += encode([(" " if spaced else "") + w for w in part])
                continue
            ends = (4 * ends).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    return PieceMemo(encode, letters=letters, added=added)


_made: dict[tuple, ChunkMemo | PieceMemo] = {}


def worker_encoder(make: Callable[..., ChunkMemo | PieceMemo], *args) -> ChunkMemo | PieceMemo:
    """One encoder of a kind in a worker process, kept from task to task."""
    if (make, *args) not in _made:
        _made[(make, *args)] = make(*args)
    return _made[(make, *args)]


def slices(batches: Iterable, rows: int = 256, chars: int = 4_000_000, column: str = "text") -> Iterator:
    """Arrow batches cut into pieces of few rows and characters (one row at least)."""
    for b in batches:
        sizes = b.column(column).nbytes
        step = max(1, min(rows, int(b.num_rows * chars / max(sizes, 1)) or 1))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def hand_back() -> None:
    """Give memory that a task has freed back to the system: workers stay, and the allocators would keep it for the stages that follow."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # of the GNU C library
        ctypes.CDLL(None).malloc_trim(0)
