"""Byte-level BPE encoding and decoding with finite-state machines.

Encoding. The merges, given as token ranks, are compiled into a transducer over bytes. Its
non-deterministic form has a state for each (last token, place in the token trie): reading a byte
walks the trie, and where a token ends, the walk may start anew with that token as the last one, if
the two tokens are a valid neighbourhood, that is if merging their joined bytes gives back the pair.
A sequence is the BPE encoding exactly if all its neighbours are valid. The machine is made
deterministic lazily: a state is the set of open walks, built when first reached from what each walk
does on the byte, and a step says which token ends there. Exactly one does, since every prefix has one
encoding, so the tokens that end at each place hold the encodings of all open walks. Those that all
walks agree on are emitted every so many bytes; walks are never further apart than a token is long.
The tables of walks and states are bounded and start anew when full.

Decoding. Token bytes run through a UTF-8 state machine that keeps an unfinished character across
tokens and chunks; malformed bytes become U+FFFD, one for each maximal part of a character.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from monthgrid.llm import wordhash as wh
from monthgrid.llm.common import Remembered
from monthgrid.llm.patterns import Pieces

MAX_STATES = 100_000
MAX_WALKS = 150_000
MAX_PIECES = 100_000
_ROOT = 0
_NEVER = 1 << 60
_STUCK = (-1, -1)
#: With so many tokens below a node, a walk is told by those that may end it.
_FEW = 16
#: Bytes after which what all walks agree on is emitted.
_LOOK_BACK = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _merge(piece: bytes, ranks: dict[bytes, int], least: int) -> list[bytes]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        best = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
        if best[0] == _NEVER:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merging by definition, for short strings: join the adjacent pair of the lowest rank, leftmost first."""
    return [ranks[p] for p in _merge(piece, ranks, 1)]


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two parts that a token is merged from in the end."""
    return _merge(token, ranks, 2)


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.order = sorted(self.tokens, key=self.tokens.get)
        self.trie: list[dict[int, int]] = [{}]
        #: By node: its token, its depth, and the places in ``order`` of the tokens below it.
        self.token_at, self.depth = [-1], array("i", [0])
        self.low, self.high = array("i", [0]), array("i", [len(self.order)])
        for place, token in enumerate(self.order):
            node = _ROOT
            for depth, byte in enumerate(self.tokens[token], 1):
                to = self.trie[node].get(byte)
                if to is None:
                    to = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                    self.depth.append(depth)
                    self.low.append(place)
                    self.high.append(place)
                node = to
                self.high[node] = place + 1
            self.token_at[node] = token
            self.low[node] += 1
        self.whole: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self._forget()

    def _forget(self) -> None:
        #: Walks: (last token, node) by number, or with few tokens below the node (those that may still end there, node).
        self.walk_numbers: dict[tuple, int] = {}
        self.walk_at: list[tuple] = []
        #: What a walk does on a byte, by both.
        self.moves: dict[int, tuple[int, int]] = {}
        #: States: sets of walks by number, the token that ends where one is reached, and the next state by state and byte.
        self.states: dict[tuple[int, ...], int] = {}
        self.walks: list[tuple[int, ...]] = []
        self.finished: list[int] = []
        self.steps: dict[int, int] = {}
        self.start = self._state((self._walk(-1, _ROOT),))

    def _walk(self, last: int | tuple[int, ...], node: int) -> int:
        walk = last, node
        number = self.walk_numbers.get(walk)
        if number is None:
            number = self.walk_numbers[walk] = len(self.walk_at)
            self.walk_at.append(walk)
        return number

    def _state(self, walks: tuple[int, ...]) -> int:
        """The last of the walks has just begun, with the token that ends here as the last one."""
        number = self.states.get(walks)
        if number is None:
            number = self.states[walks] = len(self.walks)
            self.walks.append(walks)
            self.finished.append(self.walk_at[walks[-1]][0])
        return number

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """Parts of ``token`` that touch its right or left end while it is merged, with the rank that uses each up."""
        edges = self.edges[right]
        if token not in edges:
            name = self.tokens[token]
            if len(name) == 1:
                edges[token] = [(name, _NEVER)]
            else:
                half = _last_merge(name, self.ranks)[right]
                inner = self._edge(self.ranks[half], right)
                edges[token] = [*inner[:-1], (half, token), (name, _NEVER)]
        return edges[token]

    def _follows(self, last: int, token: int) -> bool:
        """Whether merging the joined bytes of the two would give back the two."""
        if token not in self.whole:
            self.whole[token] = merge(self.tokens[token], self.ranks) == [token]
        if not self.whole[token]:
            return False
        if last < 0:
            return True
        left, right = self._edge(last, True), self._edge(token, False)
        i = j = 0
        while True:
            (a, a_used), (b, b_used) = left[i], right[j]
            # Equal ranks merge from the left.
            joined = self.ranks.get(a + b, _NEVER)
            if joined < a_used and joined <= b_used and joined < _NEVER:
                return False
            if a_used == b_used == _NEVER:
                return True
            if a_used <= b_used:
                i += 1
            else:
                j += 1

    def _move(self, walk: int, byte: int) -> tuple[int, int]:
        """The walk after ``byte``, -1 if no token can end it any more, and the token that may end there, -1 for none."""
        last, node = self.walk_at[walk]
        to = self.trie[node].get(byte)
        if to is None:
            return _STUCK
        token, low, high = self.token_at[to], self.low[to], self.high[to]
        if type(last) is tuple:
            if token >= 0 and low - 1 not in last:
                token = -1
            last = tuple([i for i in last if low <= i < high])
        else:
            if token >= 0 and not self._follows(last, token):
                token = -1
            if high - low <= _FEW:
                last = tuple([i for i in range(low, high) if self._follows(last, self.order[i])])
        return self._walk(last, to) if last != () else -1, token

    def _build(self, state: int, byte: int) -> int:
        """The state after one more byte, its walks oldest first."""
        after, finished, moves = [], -1, self.moves
        for walk in self.walks[state]:
            move = moves.get(walk << 8 | byte)
            if move is None:
                move = moves[walk << 8 | byte] = self._move(walk, byte)
            to, token = move
            if to >= 0:
                after.append(to)
            if token >= 0:
                finished = token
        after.append(self._walk(finished, _ROOT))
        step = self.steps[state << 8 | byte] = self._state(tuple(after))
        return step

    def encode(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        if len(self.walks) >= MAX_STATES or len(self.walk_at) >= MAX_WALKS:
            self._forget()
        out: list[int] = []
        # The token that ends at each place since the tokens in ``out``. Its length leads back to the one before.
        ends: list[int] = []
        state, steps, finished = self.start, self.steps, self.finished
        for at in range(0, len(piece), _LOOK_BACK):
            if at:
                out += self._settle(ends, state)
                if len(self.walks) >= MAX_STATES or len(self.walk_at) >= MAX_WALKS:
                    walks = [self.walk_at[w] for w in self.walks[state]]
                    self._forget()
                    state = self._state(tuple([self._walk(*w) for w in walks]))
                    steps, finished = self.steps, self.finished
            for byte in piece[at : at + _LOOK_BACK]:
                key = state << 8 | byte
                state = steps[key] if key in steps else self._build(state, byte)
                ends.append(finished[state])
        return out + self._chain(ends, len(ends))

    def _chain(self, ends: list[int], place: int) -> list[int]:
        tokens = []
        while place > 0:
            tokens.append(ends[place - 1])
            place -= len(self.tokens[tokens[-1]])
        return tokens[::-1]

    def _settle(self, ends: list[int], state: int) -> list[int]:
        """Takes off ``ends`` the tokens that all open walks share, so that a long piece is not held back whole."""
        chains = [self._chain(ends, len(ends) - self.depth[self.walk_at[w][1]]) for w in self.walks[state]]
        n = 0
        while all(len(c) > n for c in chains) and len({c[n] for c in chains}) == 1:
            n += 1
        settled = chains[0][:n]
        del ends[: sum(len(self.tokens[t]) for t in settled)]
        return settled


class Encoder:
    """Ids of whole texts. The pieces that the pattern cuts are merged separately; they are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.machine = Transducer(ranks)
        self.pieces = Pieces(pattern)
        self.piece = Remembered(self._piece, MAX_PIECES)

    def _piece(self, piece: str) -> bytes:
        return array("i", self.machine.encode(piece.encode())).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        pieces, known = self.pieces.findall(text), self.piece.new.get
        out = [known(p) for p in pieces]
        if None in out:
            out = [self.piece(p) if x is None else x for x, p in zip(out, pieces, strict=True)]
        return b"".join(out)


def _utf8_steps() -> list[list[int]]:
    """Next state by state and byte, -1 for a byte that cannot follow. States 1-3 await as many bytes."""
    steps = [[-1] * 256 for _ in range(8)]

    def allow(state: int, low: int, high: int, to: int) -> None:
        steps[state][low : high + 1] = [to] * (high - low + 1)

    allow(0, 0x00, 0x7F, 0)
    allow(0, 0xC2, 0xDF, 1)
    allow(0, 0xE1, 0xEF, 2)
    allow(0, 0xE0, 0xE0, 4)
    allow(0, 0xED, 0xED, 5)
    allow(0, 0xF1, 0xF3, 3)
    allow(0, 0xF0, 0xF0, 6)
    allow(0, 0xF4, 0xF4, 7)
    for state in (1, 2, 3):
        allow(state, 0x80, 0xBF, state - 1)
    allow(4, 0xA0, 0xBF, 1)
    allow(5, 0x80, 0x9F, 1)
    allow(6, 0x90, 0xBF, 2)
    allow(7, 0x80, 0x8F, 2)
    return steps


_UTF8 = _utf8_steps()
_REPLACEMENT = "�".encode()


class StreamDecoder:
    """Text from ids, chunk by chunk; ``finish`` ends the stream."""

    def __init__(self, tokens: list[bytes], complete: np.ndarray) -> None:
        self.tokens, self.complete = tokens, complete
        self.state, self.open = 0, b""

    def _bytes(self, data: bytes) -> bytes:
        out, state, char = [], self.state, bytearray(self.open)
        for byte in data:
            to = _UTF8[state][byte]
            if to < 0 and state:
                out.append(_REPLACEMENT)
                char.clear()
                to = _UTF8[0][byte]
            if to < 0:
                out.append(_REPLACEMENT)
                to = 0
            else:
                char.append(byte)
                if to == 0:
                    out.append(bytes(char))
                    char.clear()
            state = to
        self.state, self.open = state, bytes(char)
        return b"".join(out)

    def feed(self, ids: np.ndarray) -> bytes:
        """The characters that are complete by now, in UTF-8. Runs of tokens that are whole characters are joined as they are."""
        out, at = [], 0
        listed = ids.tolist()
        for broken in [*np.flatnonzero(~self.complete[ids]).tolist(), len(listed)]:
            while self.state and at < broken:
                out.append(self._bytes(self.tokens[listed[at]]))
                at += 1
            out += [self.tokens[i] for i in listed[at:broken]]
            if broken < len(listed):
                out.append(self._bytes(self.tokens[listed[broken]]))
            at = broken + 1
        return b"".join(out)

    def finish(self) -> bytes:
        left, self.state, self.open = self.state, 0, b""
        return _REPLACEMENT if left else b""


def _is_complete(token: bytes) -> bool:
    state = 0
    for byte in token:
        state = _UTF8[state][byte]
        if state < 0:
            return False
    return state == 0


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens, np.array([_is_complete(t) for t in tokens])


def _lists(encoded: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), np.int32)))


def encode(docs: DataFrame, id_cols: list[str], ranks_path: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id_cols`` and ``ids`` (array of int), and with ``decoded`` also ``decoded``, the text that the ids give back.

    ``ranks_path`` is a file of base64 tokens and ranks that the workers can read; ``pattern`` cuts a text
    into the pieces that are merged separately. One row per input row, in any number of copies; NULL and
    empty texts have no ids and decode to the empty text; NULL ids of rows are carried. Other columns are
    not read, so their names cannot clash. An empty table gives an empty result.
    """
    rows = docs.select(*id_cols, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            for part in wh.slices(batch, "_text"):
                ids = [encoder.encode(t) for t in part.column("_text").to_pylist()]
                columns, names = [part.column(c) for c in id_cols] + [_lists(ids)], [*id_cols, "ids"]
                if decoded:
                    columns.append(pa.array(_decode([np.frombuffer(x, np.int32) for x in ids], ranks_path), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    out = [*[rows.schema[c] for c in id_cols], StructField("ids", ArrayType(IntegerType()))]
    return rows.mapInArrow(run, StructType(out + [StructField("decoded", StringType())] * decoded))


def _decode(lists: Iterable[np.ndarray], ranks_path: str) -> list[bytes]:
    decoder = StreamDecoder(*_vocabulary(ranks_path))
    return [decoder.feed(ids) + decoder.finish() for ids in lists]


def decode(df: DataFrame, id_cols: list[str], ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``id_cols`` and ``decoded``. A NULL list counts as empty; an id outside the vocabulary is an error."""
    rows = df.select(*id_cols, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = (np.array(x.values.to_numpy(zero_copy_only=False), np.int32) for x in batch.column("_ids"))
            texts = pa.array(_decode(lists, ranks_path), pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in id_cols], texts], [*id_cols, "decoded"])

    return rows.mapInArrow(run, StructType([*[rows.schema[c] for c in id_cols], StructField("decoded", StringType())]))
