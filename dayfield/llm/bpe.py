"""Operator 13: byte-level BPE as a lazily determinised transducer, and streaming decoding by a UTF-8 state machine."""

from __future__ import annotations

import base64
import itertools
import operator
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States, pieces and pairs that a worker keeps; beyond, the tables are emptied and fill again. Results do not depend on them.
MOST_STATES, MOST_PIECES, MOST_PAIRS = 300_000, 400_000, 400_000
#: Pieces up to this many characters are kept, and texts from this many are split piece by piece.
KEPT_PIECE, LONG_TEXT = 40, 1_000_000
#: Bytes of a piece after which tokens that are sure are handed out; a longer piece is held in parts of this size.
BLOCK = 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class State(dict):
    """A determinised state: the trie node of the token that may have begun first, and for every place where the next token may have
    begun the token before it. It holds byte -> (state, token that ends here if the text does), made when first asked for."""

    __slots__ = ("node", "lefts", "step")

    def __init__(self, node: int, lefts: tuple[int, ...], step: Callable[[State, int], tuple[State, int]]) -> None:
        self.node, self.lefts, self.step = node, lefts, step

    def __missing__(self, byte: int) -> tuple[State, int]:
        return self.step(self, byte)


class Transducer:
    """Merges by rank as a finite-state transducer over bytes.

    The tokens of a prefix are those of a shorter prefix and one more token: the one that stands behind the last of the
    shorter prefix without a merge across their border. A nondeterministic state is thus (last token, trie node of the token being
    read), and a determinised one is the set of those that are still open; sets and steps are made when first entered. Each step
    tells the last token of the prefix read so far. A token is emitted once all readings that are still open share it, which those
    that begin within the longest token's length decide."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._length = {i: len(t) for t, i in ranks.items()}
        self._edges: dict[int, int] = {}
        self._token_at: dict[int, int] = {}
        self._depth: dict[int, int] = {0: 0}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._spines: tuple[dict[int, list], dict[int, list]] = {}, {}
        self._opened: dict[int, tuple[int, ...]] = {0: (0,)}
        self._moves: dict[int, tuple] = {}
        nodes = itertools.count(1)
        for token, rank in ranks.items():
            node = 0
            for depth, byte in enumerate(token, 1):
                key = node << 8 | byte
                if (child := self._edges.get(key)) is None:
                    child = self._edges[key] = next(nodes)
                    self._depth[child] = depth
                node = child
            self._token_at[node] = rank
        self._reset()

    def _reset(self) -> None:
        self._states: dict[tuple, State] = {}
        self._make = self.step
        self.start = self._state(0, (-1,))

    def _state(self, node: int, lefts: tuple[int, ...]) -> State:
        found = self._states.get((node, lefts))
        if found is None:
            if len(self._states) >= MOST_STATES:
                self._reset()
            found = self._states[node, lefts] = State(node, lefts, self._make)
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of ``token`` joins; None for a byte, and for a token that merges do not reach."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 62:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that made it, -1 for a byte) along one edge of the tree of merges, from the top down."""
        if (found := self._spines[side].get(token)) is None:
            pair = self.halves(token)
            found = self._spines[side][token] = [(token, token), *self._spine(pair[side], side)] if pair else [(token, -1)]
        return found

    def adjacent(self, one: int, two: int) -> bool:
        """Whether the merges leave ``one`` and ``two`` side by side: no pair that meets at their border while they grow is merged.

        Of merges of equal rank the left one comes first."""
        key = (one, two)
        if (found := self._pairs.get(key)) is not None:
            return found
        lefts, rights = self._spine(one, 1), self._spine(two, 0)
        i = j = 0
        left_until, right_until, apart = 1 << 62, 1 << 62, True
        while True:
            (a, a_from), (b, b_from) = lefts[i], rights[j]
            rank = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if rank is not None and rank < left_until and rank <= right_until:
                apart = False
                break
            if a_from > b_from:
                left_until, i = a_from, i + 1
            elif b_from >= 0:
                right_until, j = b_from, j + 1
            else:
                break
        if len(self._pairs) >= MOST_PAIRS:
            self._pairs.clear()
        self._pairs[key] = apart
        return apart

    def _move(self, node: int, byte: int) -> tuple:
        """What a byte does to the open places, whatever the tokens before them: (longest node, which places stay open, (place, token)
        of the tokens that may end here)."""
        places = self._opened[node]
        grown = [(i, child) for i, n in enumerate(places) if (child := self._edges.get(n << 8 | byte)) is not None]
        if not grown:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        nodes = tuple(child for _, child in grown)
        self._opened.setdefault(nodes[0], (*nodes, 0))
        stay = [i for i, _ in grown]
        ends = tuple((i, t) for i, child in grown if (t := self._token_at.get(child)) is not None and (self._length[t] == 1 or self.halves(t)))
        if len(self._moves) >= MOST_PAIRS:
            self._moves.clear()
        keep = operator.itemgetter(*stay) if len(stay) > 1 else lambda lefts, i=stay[0]: (lefts[i],)
        self._moves[node << 8 | byte] = nodes[0], keep, ends
        return nodes[0], keep, ends

    def step(self, state: State, byte: int) -> tuple[State, int]:
        """The next state and the last token of what is read by then; made once and kept in the state."""
        node, keep, _ = self._moves.get(state.node << 8 | byte) or self._move(state.node, byte)
        token = self._last(state, byte)
        found = state[byte] = self._state(node, (*keep(state.lefts), token)), token
        return found

    def _last(self, state: State, byte: int) -> int:
        """The token that ends with the byte if the text does; no state is made for what nothing may follow."""
        _, _, ends = self._moves.get(state.node << 8 | byte) or self._move(state.node, byte)
        lefts, pairs = state.lefts, self._pairs
        for place, token in ends:
            left = lefts[place]
            if left < 0 or (near := pairs.get((left, token))) or (near is None and self.adjacent(left, token)):
                return token
        raise ValueError(f"no reading of the text ends at byte {byte}: the vocabulary's ranks are not those of merges")

    def feed(self, data: bytes) -> Iterator[list[int]]:
        """Tokens of one piece of text in lists, each as soon as it is sure; pieces longer than ``BLOCK`` bytes are held in parts."""
        state, last, length = self.start, [], self._length
        for begin in range(0, len(data), BLOCK):
            for byte in data[begin : begin + BLOCK]:
                state, token = state[byte]
                last.append(token)
            if begin + BLOCK < len(data):
                readings = [set(self._ends(last, len(last) - self._depth[node])) for node in self._opened[state.node]]
                if sure := sorted(set.intersection(*readings)):
                    yield [last[e - 1] for e in sure]
                    del last[: sure[-1]]
        out, at = [], len(last)
        while at > 0:
            out.append(last[at - 1])
            at -= length[last[at - 1]]
        yield out[::-1]

    def _ends(self, last: list[int], at: int) -> list[int]:
        """Where the tokens of the prefix of length ``at`` end."""
        out = []
        while at > 0:
            out.append(at)
            at -= self._length[last[at - 1]]
        return out[::-1]

    def tokens(self, data: bytes) -> list[int]:
        """Ids of one piece of text; one that is itself in the vocabulary is one token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) > BLOCK:
            return list(itertools.chain.from_iterable(self.feed(data)))
        state, last, length = self.start, [], self._length
        for byte in data[:-1]:
            state, token = state[byte]
            last.append(token)
        last += [state[byte][1] if byte in state else self._last(state, byte) for byte in data[-1:]]
        out, at = [], len(last)
        while at > 0:
            out.append(token := last[at - 1])
            at -= length[token]
        out.reverse()
        return out


def _ranges(points: list[int]) -> str:
    """Code points as ranges of a character class."""
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=1)
def _patterns() -> tuple[regex.Pattern, re.Pattern | None, regex.Pattern | None]:
    """(pattern, characters from the first on whose class the two regex engines differ, pattern for texts that hold one).

    ``regex`` may know a newer Unicode than tiktoken does; the classes of the latter are read from it once a worker."""
    import public_tokenizers
    import tiktoken

    everything = "".join(chr(c) for c in itertools.chain(range(0xD800), range(0xE000, 0x110000)))
    alone = {bytes([b]): b for b in range(256)}
    named = {}
    for name in (r"\p{L}", r"\p{N}"):
        reader = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=alone, special_tokens={})
        named[name] = set(bytes(reader.encode_ordinary(everything)).decode()), set(regex.findall(name, everything))
    pattern = public_tokenizers.PATTERN
    odd = sorted({ord(c) for theirs, mine in named.values() for c in theirs ^ mine})
    if not odd:
        return regex.compile(pattern), None, None
    exact = pattern
    for name, (theirs, mine) in named.items():
        more, less = (sorted(map(ord, x)) for x in (theirs - mine, mine - theirs))
        inner = f"[{name}{_ranges(more)}]" if more else name
        exact = exact.replace(name, f"[{inner}--[{_ranges(less)}]]" if less else inner)
    return regex.compile(pattern), re.compile(f"[{_ranges([odd[0]])[:-11]}-\\U0010ffff]"), regex.compile(exact, regex.V1)


class Encoder(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers, filled as pieces occur."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.machine = Transducer(ranks)
        self.pattern, self.odd, self.exact = _patterns()

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.machine.tokens(piece.encode("utf-8", "replace")), "<u4").tobytes()
        if len(piece) <= KEPT_PIECE:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; a null one is empty."""
        if not text:
            return b""
        pattern = self.exact if self.odd and not text.isascii() and self.odd.search(text) else self.pattern
        pieces = pattern.findall(text) if len(text) < LONG_TEXT else (m[0] for m in pattern.finditer(text))
        return b"".join(map(self.__getitem__, pieces))


#: First byte from, to; second byte from, to; length (the well-formed sequences of UTF-8).
WELL_FORMED = (
    (0x00, 0x7F, 0, 0, 1),
    (0xC2, 0xDF, 0x80, 0xBF, 2),
    (0xE0, 0xE0, 0xA0, 0xBF, 3),
    (0xE1, 0xEC, 0x80, 0xBF, 3),
    (0xED, 0xED, 0x80, 0x9F, 3),
    (0xEE, 0xEF, 0x80, 0xBF, 3),
    (0xF0, 0xF0, 0x90, 0xBF, 4),
    (0xF1, 0xF3, 0x80, 0xBF, 4),
    (0xF4, 0xF4, 0x80, 0x8F, 4),
)
_LEADS = {b: (low, high, n) for first, last, low, high, n in WELL_FORMED for b in range(first, last + 1)}


class Decoder:
    """Ids to text, a token at a time, whatever tokens a character is spread over.

    The state is the bytes of a character that has begun (three at most). Steps over tokens are made from steps over bytes when first
    taken, then kept; tokens of whole characters, which lead from the start to the start, are joined without steps. What is not
    well-formed becomes U+FFFD, one for each longest beginning of a character."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of = bytes_of
        self._steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self._whole: dict[int, str] = {}
        for token in bytes_of:
            text, waits = self.step(b"", token)
            if not waits:
                self._whole[token] = text
        self._steps.clear()
        self._open = np.ones(max(bytes_of) + 1, bool)
        self._open[list(self._whole)] = False

    @staticmethod
    def byte(pending: bytes, byte: int) -> tuple[str, bytes]:
        """One step of the state machine: the text that is complete now, and the bytes that still wait."""
        if pending:
            low, high, n = _LEADS[pending[0]]
            low, high = (low, high) if len(pending) == 1 else (0x80, 0xBF)
            if low <= byte <= high:
                grown = pending + bytes([byte])
                return (grown.decode(), b"") if len(grown) == n else ("", grown)
            text, waits = Decoder.byte(b"", byte)
            return "\ufffd" + text, waits
        if byte not in _LEADS:
            return "\ufffd", b""
        return (chr(byte), b"") if byte < 0x80 else ("", bytes([byte]))

    def step(self, pending: bytes, token: int) -> tuple[str, bytes]:
        text, waits = [], pending
        for byte in self.bytes_of[token]:
            more, waits = self.byte(waits, byte)
            text.append(more)
        if len(self._steps) >= MOST_PAIRS:
            self._steps.clear()
        found = self._steps[pending, token] = "".join(text), waits
        return found

    def stream(self, ids: np.ndarray) -> Iterator[str]:
        """Pieces of text as soon as they are complete."""
        pending, steps, at = b"", self._steps, 0
        for k in np.flatnonzero(self._open[ids]).tolist():
            if k < at:
                continue
            yield "".join(map(self._whole.__getitem__, ids[at:k].tolist()))
            at = k
            while at < len(ids) and (pending or at == k):
                text, pending = steps.get((pending, int(ids[at]))) or self.step(pending, int(ids[at]))
                at += 1
                yield text
        yield "\ufffd" if pending else "".join(map(self._whole.__getitem__, ids[at:].tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(encoder(path).machine.bytes_of)


def _each(batches: Iterator[pa.RecordBatch], use, kind: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([use(x.as_py()) for x in part.column(1)], kind)], ["doc_id", name])


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the whole text as little-endian unsigned 32-bit token ids, one row per row.

    ``vocabulary`` is a rank file that every executor has. Null and empty texts have no ids (an empty value, not null); repeated rows
    are encoded each; an empty table gives no rows; a null doc_id stays null. Other columns are not read, so their names cannot clash. The time follows the
    length of a text, however long its words; memory is bounded by the tables above and one text."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _each(b, encoder(path).encode, pa.binary(), "ids"), "doc_id long, ids binary")


def _unpacked(ids: bytes | None) -> np.ndarray:
    return np.frombuffer(ids or b"", "<u4")


def decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids as ``encode`` gives them; null ids are none and give an empty text. Ids that the vocabulary lacks are an
    error. Ids that do not end in whole characters give U+FFFD. Repeated rows, null doc_ids and empty tables as in ``encode``."""
    path = vocabulary or default_vocabulary()
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    text = lambda ids: "".join(decoder(path).stream(_unpacked(ids)))
    return rows.mapInArrow(lambda b: _each(b, text, pa.string(), "text"), "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, text): ids of the whole text and the text that these decode to, in one pass."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(path)
        for part in _each(batches, encoder(path).encode, pa.binary(), "ids"):
            texts = ["".join(back.stream(_unpacked(x.as_py()))) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return rows.mapInArrow(both, "doc_id long, ids binary, text string")
