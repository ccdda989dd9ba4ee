"""Byte-level BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list has a sufficient lookahead: what follows a position can change token boundaries before it only through a
chain of overlapping merges of rising rank, and the longest such chain, in bytes, is computed from the list. A piece of
text is read in windows; a token is emitted once at least that many bytes follow it, and never reconsidered, so the
state is one window however long the piece is. Decoding feeds token bytes to an incremental UTF-8 decoder.

Defined cases: null is the empty text, which has no ids; the strings of added tokens inside a text become those tokens;
bytes that aren't UTF-8, which only foreign ids can produce, decode to U+FFFD; rows aren't compared or joined, so
repeated rows, null ids and columns of other names pass as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgeno.llm.common import bounded_batches

#: Pieces whose ids are remembered, and the longest such piece in characters: this bounds a worker's memory.
REMEMBERED, LONGEST_REMEMBERED = 120_000, 48
#: Ids handled at once.
BLOCK = 1 << 16


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def _classes() -> tuple[str, str, str]:
    """Character classes for `re`: letters, numbers, white space."""

    def ranges(prefix: str) -> str:
        out, start, last = [], None, -2
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == prefix:
                if c != last + 1:
                    if start is not None:
                        out.append((start, last))
                    start = c
                last = c
        out.append((start, last))
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    return ranges("L"), ranges("N"), r"\t-\r \x85\xa0  -     　"


@lru_cache(1)
def pieces_pattern() -> re.Pattern:
    """Contractions, words, numbers and other runs, each with one leading space, and white space."""
    L, N, S = _classes()
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+(?![{L}])| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")


#: For texts of ASCII, and for others without the characters of ODD; they match what pieces_pattern() matches there.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+")


@lru_cache(1)
def _odd() -> frozenset[str]:
    """Numbers that aren't decimal digits, and separators that only `re` takes for white space."""
    return frozenset("\x1c\x1d\x1e\x1f" + "".join(chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")))


def pattern_for(text: str) -> re.Pattern:
    if text.isascii():
        return pieces_pattern() if any(c in text for c in "\x1c\x1d\x1e\x1f") else ASCII_PIECES
    return PLAIN_PIECES if _odd().isdisjoint(text) else pieces_pattern()


class _Known(dict):
    """Ids of pieces seen lately. Two generations: when the young one is full it becomes the old one, so what is still
    in use survives and memory stays bounded."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            ids = self.make(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Transducer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        chars, vocab = _byte_chars(), data["model"]["vocab"]
        as_bytes = lambda s: bytes(chars[c] for c in s)
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token = {i: as_bytes(s) for s, i in vocab.items() if s not in self.added}
        self.token |= {i: s.encode() for s, i in self.added.items()}
        self.single = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        # A pair of ids is one integer; ranks order the merges.
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.made.append(vocab[a + b])
        self.lookahead = self._sufficient_lookahead()
        self.window = max(4096, 2 * self.lookahead)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.table = np.array([self.token.get(i, b"") for i in range(max(self.token) + 1)], dtype=object)
        self.known = _Known(self._piece)

    def _sufficient_lookahead(self) -> int:
        """Most bytes, before the end of what has been read, at which later bytes can still move a token boundary.

        A merge (a, b) that what follows makes or prevents changes whether its left end is free; that can make or prevent
        only merges (c, d) of higher rank in which d begins with a or with ab. The longest such chain is found from the
        last rank to the first."""
        spine: list[tuple[int, ...]] = [()] * (max(self.token) + 1)
        for i in self.token:
            spine[i] = (i,)
        order = [(pair >> 20, pair & 0xFFFFF, self.made[rank]) for pair, rank in sorted(self.pairs.items(), key=lambda x: x[1])]
        for a, _, ab in order:
            spine[ab] = (ab, *spine[a])
        reach = [0] * len(spine)
        longest = 0
        for a, b, ab in reversed(order):
            far = len(self.token[a]) + max(reach[a], reach[ab])
            longest = max(longest, far)
            for x in spine[b]:
                reach[x] = max(reach[x], far)
        return longest + max(map(len, self.token.values()))

    def _merge(self, data: bytes) -> list[int]:
        """Ids of a few bytes: the merge of least rank, leftmost first, again and again."""
        ids = [self.single[b] for b in data]
        get, made, n, none = self.pairs.get, self.made, len(ids), 1 << 40
        if n < 2:
            return ids
        if n < 64:
            ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
            while (rank := min(ranks)) != none:
                i = ranks.index(rank)
                ids[i] = ab = made[rank]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = get(ids[i - 1] << 20 | ab, none)
                if i < len(ranks):
                    ranks[i] = get(ab << 20 | ids[i + 1], none)
                elif not ranks:
                    break
            return ids
        # Linked list and heap for long pieces.
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := get(a << 20 | b, none)) != none]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) < 0 or ids[j] != b:
                continue
            ids[i], alive[j] = (ab := made[rank]), False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rank := get(ab << 20 | ids[k], none)) != none:
                    heapq.heappush(heap, (rank, i, ab, ids[k]))
            if (h := before[i]) >= 0 and (rank := get(ids[h] << 20 | ab, none)) != none:
                heapq.heappush(heap, (rank, h, ids[h], ab))
        return [x for x, keep in zip(ids, alive) if keep]

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that arrives in parts; a token is emitted once the lookahead beyond it is read."""
        held = b""
        for part in parts:
            for at in range(0, len(part), self.window):
                held += part[at : at + self.window]
                if len(held) <= 2 * self.window:
                    continue
                stable, used = len(held) - self.lookahead, 0
                for i in self._merge(held):
                    if used + len(self.token[i]) > stable:
                        break
                    used += len(self.token[i])
                    yield i
                held = held[used:]
        yield from self._merge(held)

    def _piece(self, piece: str) -> bytes:
        """Little-endian ids of one piece."""
        return array("I", self.stream((piece.encode(),))).tobytes()

    def parts(self, text: str) -> Iterator[str]:
        """Text without added tokens, an added token, and so on; one part at a time."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield text[at : m.start()]
            yield m[0]
            at = m.end()
        yield text[at:] if at else text

    def encode(self, text: str) -> Iterator[bytes]:
        """Little-endian 32-bit ids of a whole text, in blocks."""
        known = self.known.__getitem__
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                yield self.added[part].to_bytes(4, "little")
            elif part:
                pattern = pattern_for(part)
                if len(part) <= BLOCK:
                    yield b"".join(map(known, pattern.findall(part)))
                    continue
                held: list[bytes] = []
                for m in pattern.finditer(part):
                    if len(m[0]) <= self.window:
                        held.append(known(m[0]))
                        if len(held) < BLOCK:
                            continue
                    yield b"".join(held)
                    held.clear()
                    if len(m[0]) > self.window:
                        # A long piece is read and emitted block by block.
                        piece = self.stream(m[0][i : i + BLOCK].encode() for i in range(0, len(m[0]), BLOCK))
                        while block := array("I", islice(piece, BLOCK)):
                            yield block.tobytes()
                yield b"".join(held)

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode(text)), dtype="<u4").tolist()

    def decode(self, blocks: Iterable[list[int] | np.ndarray]) -> Iterator[str]:
        """Text of blocks of ids; the decoder's state carries a character split between blocks."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            yield state.decode(b"".join(self.table[np.asarray(ids, dtype=np.int64)].tolist()))
        yield state.decode(b"", True)


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            n, ids, texts = [], [], []
            for x in b.column(1):
                h, g = hashlib.sha256(), hashlib.sha256()
                count = 0

                # Each block of ids is digested and decoded as it comes; none is kept.
                def blocks(text: str) -> Iterator[np.ndarray]:
                    nonlocal count
                    for raw in t.encode(text):
                        h.update(raw)
                        count += len(raw) // 4
                        yield np.frombuffer(raw, dtype="<u4")

                for s in t.decode(blocks(x.as_py() or "")):
                    g.update(s.encode())
                n.append(count)
                ids.append(h.hexdigest())
                texts.append(g.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each whole text; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_digests(path), f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            at = b.schema.get_field_index("__text")
            ids = [np.frombuffer(b"".join(t.encode(x.as_py() or "")), dtype="<u4").astype(np.int32) for x in b.column(at)]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([c for k, c in enumerate(b.columns) if k != at] + [pa.ListArray.from_arrays(pa.array(offsets), values)], [n for n in b.schema.names if n != "__text"] + ["ids"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(_encoded(path), f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            texts = ["".join(t.decode([x.as_py() or []])) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {dict(rows.dtypes)[id_col]}, text string")
