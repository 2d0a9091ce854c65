"""Byte-pair encoding of whole corpora with a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Split of a text into pieces before merging, as the vocabulary was made with. Fixed value of the public tokenizer.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_ranks(path: str = VOCABULARY) -> bytes:
    """The vocabulary file as it is: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return f.read()


class Transducer:
    """Byte-pair merges compiled into a deterministic transducer, whose states are made when first met.

    After any prefix of a piece exactly one token can end its encoding: the token that ends there and is compatible with the last
    token of the shorter prefix before it (merging the two alone gives the two back). A state is the set of tokens
    begun but not ended, each with the token before it. Reading a byte moves every begun token one byte on, drops those no
    token of the vocabulary continues, and outputs the one token that ends here validly. Equal sets are one state, so
    the work per byte, once a state is known, is one lookup. A token is final as soon as all begun tokens lead back to
    it, at most about the longest token later; long pieces are emitted that way in between, so memory stays bounded.
    """

    MOST_STATES, MOST_PIECES, SETTLE = 50_000, 60_000, 8192

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.lengths = {rank: len(token) for token, rank in self.ranks.items()}
        self.split = regex.compile(PIECES)
        self.step: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.depth = [0]
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                at = node << 8 | byte
                nxt = self.step.get(at)
                if nxt is None:
                    nxt = self.step[at] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.ends[node] = rank
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        """Drops all states but the first."""
        self.states: dict[tuple, dict] = {}
        self.sets: dict[int, tuple] = {}
        self.first = self._state(((0, -1),))

    def _state(self, begun: tuple) -> dict:
        s = self.states.get(begun)
        if s is None:
            s = self.states[begun] = {}
            self.sets[id(s)] = begun
        return s

    def merge(self, data: bytes) -> list[int]:
        """Merging by rank, pair by pair: the definition, used on one or two tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fit(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: the start of a piece)."""
        known = self.fits.get((before, token))
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            both = self.tokens[token] if before < 0 else self.tokens[before] + self.tokens[token]
            known = self.fits[before, token] = self.merge(both) == ([token] if before < 0 else [before, token])
        return known

    def _move(self, state: dict, byte: int) -> tuple[dict, int]:
        """Determinises one transition."""
        begun, out = [], -1
        for node, before in self.sets[id(state)]:
            node = self.step.get(node << 8 | byte)
            if node is not None:
                begun.append((node, before))
                token = self.ends.get(node)
                if token is not None and out < 0 and self.fit(before, token):
                    out = token
        begun.append((0, out))
        if len(self.states) >= self.MOST_STATES:
            self._forget()
        move = (self._state(tuple(begun)), out)
        if id(state) in self.sets:
            state[byte] = move
        return move

    def _back(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(ends[at])
            at -= self.lengths[ends[at]]
        out.reverse()
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        out: list[int] = []
        ends, state = [-1], self.first
        for byte in data:
            move = state.get(byte) or self._move(state, byte)
            state = move[0]
            ends.append(move[1])
            if len(ends) > self.SETTLE:
                ends = self._settle(ends, state, out)
        return out + self._back(ends, len(ends) - 1)

    def _settle(self, ends: list[int], state: dict, out: list[int]) -> list[int]:
        """Emits what all begun tokens agree on, and keeps the rest."""
        here = len(ends) - 1
        starts = {here - self.depth[node] for node, _ in self.sets[id(state)]}
        while len(starts) > 1:
            last = max(starts)
            starts.discard(last)
            starts.add(last - self.lengths[ends[last]])
        done = starts.pop()
        if done > 0:
            out += self._back(ends, done)
            ends = [-1, *ends[done + 1 :]]
        return ends

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text, without special tokens; none for an empty or null text."""
        out: list[int] = []
        if not text:
            return out
        pieces = self.pieces
        for piece in self.split.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= 64:
                    if len(pieces) >= self.MOST_PIECES:
                        pieces.clear()
                    pieces[piece] = ids
            out += ids
        return out


class Utf8Machine:
    """Decodes bytes that come in any portions: the state is the code point so far, the bytes it still lacks and the bounds of the next.

    A byte that can't come next gives U+FFFD for the broken sequence and is read again as a first byte.
    """

    def __init__(self) -> None:
        self.point, self.lacking, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.lacking:
                if self.low <= b <= self.high:
                    self.point, self.lacking, self.low, self.high = self.point << 6 | b & 0x3F, self.lacking - 1, 0x80, 0xBF
                    if not self.lacking:
                        out.append(chr(self.point))
                    continue
                out.append("�")
                self.lacking, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.point, self.lacking = b & 0x1F, 1
            elif 0xE0 <= b <= 0xEF:
                self.point, self.lacking = b & 0x0F, 2
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.point, self.lacking = b & 0x07, 3
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        broken, self.lacking, self.low, self.high = bool(self.lacking), 0, 0x80, 0xBF
        return "�" if broken else ""


_made: dict[bytes, Transducer] = {}


def transducer(file: bytes) -> Transducer:
    """One transducer per vocabulary and Python worker; its states stay warm between tasks."""
    key = hashlib.sha256(file).digest()
    if key not in _made:
        _made.clear()
        _made[key] = Transducer(file)
    return _made[key]


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(spark: SparkSession, documents: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, rows_at_once: int = 256) -> DataFrame:
    """``ident, ids``: the token ids of every text, without special tokens. One pass, no shuffle.

    The vocabulary file (under 1 MB, whatever the corpus) is read on the driver and broadcast; its path is a parameter.
    Defined results: an empty list for an empty and for a null text; strings that look like special tokens are plain text;
    repeated rows give repeated rows; other columns are not read.
    """
    file = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(file.value)
        for b in batches:
            for i in range(0, b.num_rows, rows_at_once):
                part = b.slice(i, rows_at_once)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([t.encode(x) for x in part.column(1).to_pylist()])], names=["ident", "ids"])

    kind = documents.schema[ident].dataType.simpleString()
    out = documents.select(documents[ident].alias("ident"), documents[text].alias("text")).mapInArrow(run, f"ident {kind}, ids array<int>")
    return out.withColumnRenamed("ident", ident)


def count_tokens(spark: SparkSession, documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents`` with ``n_tokens`` in place of the text; 0 for an empty and for a null text."""
    file = spark.sparkContext.broadcast(load_ranks(vocabulary))
    rest = [c for c in documents.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(file.value)
        for b in batches:
            n = pa.array([len(t.encode(x)) for x in b.column(len(rest)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(rest))], n], names=[*rest, "n_tokens"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest)
    return documents.select(*[documents[c] for c in rest], documents[text]).mapInArrow(run, f"{kinds}, n_tokens long")


def decode(spark: SparkSession, encoded: DataFrame, ident: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``ident, text``: the texts of token ids. Tokens that are whole characters are looked up; the others go through the state machine.

    Defined results: an empty or null list gives an empty text; bytes that are no UTF-8 give U+FFFD; an unknown id fails.
    """
    file = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = transducer(file.value).tokens
        whole: dict[int, str] = {}
        for rank, token in tokens.items():
            try:
                whole[rank] = token.decode()
            except UnicodeDecodeError:
                pass
        for b in batches:
            texts = []
            for row in b.column(1).to_pylist():
                machine, parts = Utf8Machine(), []
                for i in row or ():
                    quick = whole.get(i) if not machine.lacking else None
                    parts.append(quick if quick is not None else machine.feed(tokens[i]))
                texts.append("".join(parts) + machine.end())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["ident", "text"])

    kind = encoded.schema[ident].dataType.simpleString()
    return encoded.select(encoded[ident].alias("ident"), encoded[ids].alias("ids")).mapInArrow(run, f"ident {kind}, text string").withColumnRenamed("ident", ident)
