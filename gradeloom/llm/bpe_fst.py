"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A byte string has one BPE segmentation, and it is valid exactly if each two neighbouring
tokens stay apart when merged on their own. So the segmentation of a prefix is known from
its last token. The transducer reads bytes; its state holds, for each earlier cut from which
some token of the vocabulary may still reach past the current byte, the node of the token
trie, the last token before the cut, and the tokens before the cut that are not emitted yet.
What all cuts agree on is emitted by the arc that brings it about: as no token is longer than
the longest of the vocabulary, that happens after bounded lookahead. At the end of a piece
the state gives out what it holds back. States and arcs are made when first needed; they are
dropped and made again when there are too many.

``encode_all`` runs many pieces at once: all of them read their next byte in one numpy step
(arcs lie in a hash table of arrays), and Python only makes arcs that are new. ``steps``
streams one piece by the same arcs.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .places import Grown, Places, Store, spread

#: States that a transducer keeps before it starts over.
MAX_STATES = 300_000
#: Strings whose tokens a worker keeps before it starts over, and their tokens.
MAX_PLACES, MAX_KEPT = 300_000, 4_000_000
#: Pieces of more bytes than this are streamed one by one.
LONG = 512
_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _ArcTable:
    """Arcs by state * 256 + byte, in open addressing: next state and number of the output."""

    M = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, power: int = 16):
        self.power, self.n = power, 0
        self.keys = np.full(1 << power, -1, dtype=np.int64)
        self.to = np.zeros((1 << power, 2), dtype=np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free slot that it would take."""
        mask = len(self.keys) - 1
        at = ((keys.astype(np.uint64) * self.M) >> np.uint64(64 - self.power)).astype(np.int64)
        there = self.keys[at]
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            there = self.keys[at[open_]]
            open_ = open_[(there != keys[open_]) & (there != -1)]
        return at

    def add(self, keys: list[int], to: list[tuple[int, int]]) -> None:
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = self.keys >= 0
            old_keys, old_to = self.keys[held], self.to[held]
            self.__init__((4 * (self.n + len(keys))).bit_length())
            self._put(old_keys, old_to)
        self._put(np.array(keys, dtype=np.int64), np.array(to, dtype=np.int32).reshape(-1, 2))

    def _put(self, keys: np.ndarray, to: np.ndarray) -> None:
        left = np.arange(len(keys))
        while len(left):
            at = self.slots(keys[left])
            self.keys[at] = keys[left]  # of several keys at one free slot the last stays, the others try again
            won = self.keys[at] == keys[left]
            self.to[at[won]] = to[left[won]]
            self.n += int(won.sum())
            left = left[~won]


class MergeTransducer:
    """Encodes byte strings by merge ranks. ``encode_all`` reads many pieces; ``steps`` streams one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelled = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                down = self.children[node].get(byte)
                if down is None:
                    down = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = down
            self.token_at[node] = rank
        self.apart: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._restart()

    def _restart(self) -> None:
        self.numbers: dict[tuple, int] = {}
        #: For each state its cuts, those from the earliest first: (node, last token, tokens held back).
        self.states: list[tuple[tuple[int, int, tuple[int, ...]], ...]] = []
        #: What each state gives out at the end of a piece, as a number of an output.
        self.final = Grown("i4")
        self.arcs = _ArcTable()
        #: Outputs by number: tuples of tokens, and the same as flat arrays.
        self.outputs: dict[tuple[int, ...], int] = {}
        self.output_of: list[tuple[int, ...]] = []
        self.flat, self.first, self.size = Grown("i4"), Grown("i4"), Grown("i4")
        self._output(())
        self._number(((0, -1, ()),))

    def _output(self, tokens: tuple[int, ...]) -> int:
        number = self.outputs.get(tokens)
        if number is None:
            number = self.outputs[tokens] = len(self.output_of)
            self.output_of.append(tokens)
            self.first.extend((self.flat.n,))
            self.size.extend((len(tokens),))
            self.flat.extend(tokens)
        return number

    def _number(self, state: tuple) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.final.extend((self._output(state[-1][2]),))
        return number

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first, until none merge."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            best, at = min(((self.ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == _NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or what merging never makes."""
        if token not in self.halves:
            parts = self.merged(self.spelled[token], 2)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 and self.length[token] > 1 else None
        return self.halves[token]

    def _reachable(self, token: int) -> bool:
        return self.length[token] == 1 or self._halves(token) is not None

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether left and right, side by side, are what merging their bytes gives.

        Merges are undone from the last, at the seam; the pair there must never have been due before.
        """
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            known = self._reachable(right) and (left < 0 or self._seam_holds(left, right))
            self.apart[key] = known
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        bound = _NONE
        while True:
            if self.ranks.get(self.spelled[left] + self.spelled[right], bound) < bound:
                return False
            a, b = self._halves(left), self._halves(right)
            if a and (left > right or not b):
                bound, left = left, a[1]  # of equal ranks the left merge comes first
            elif b:
                bound, right = right + 1, b[0]
            else:
                return True

    def _arc(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and output: each cut that can reads on, and a new one is where a token ends."""
        cuts, ending = [], None
        for node, last, held in self.states[state]:
            down = self.children[node].get(byte)
            if down is None:
                continue
            token = self.token_at[down]
            if token >= 0 and ending is None and self._stay_apart(last, token):
                ending = (0, token, (*held, token))
            if self.children[down]:
                cuts.append((down, last, held))
        if ending is None:
            raise ValueError("the vocabulary lacks a byte")
        cuts.append(ending)
        agreed, least = 0, min(len(c[2]) for c in cuts)
        while agreed < least and all(c[2][agreed] == ending[2][agreed] for c in cuts):
            agreed += 1
        out = ending[2][:agreed]
        if agreed:
            cuts = [(node, last, held[agreed:]) for node, last, held in cuts]
        return self._number(tuple(cuts)), self._output(out)

    def _follow(self, keys: np.ndarray) -> np.ndarray:
        """Next states and outputs of the arcs, made where there are none yet."""
        at = self.arcs.slots(keys)
        lacking = self.arcs.keys[at] != keys
        if lacking.any():
            new = np.unique(keys[lacking]).tolist()
            self.arcs.add(new, [self._arc(k >> 8, k & 255) for k in new])
            at = self.arcs.slots(keys)
        return self.arcs.to[at]

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, one after the other, and how many each has."""
        if len(self.states) > MAX_STATES:
            self._restart()
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        # an output for each byte and one for each end
        starts = np.cumsum(sizes + 1) - sizes - 1
        begin = starts - np.arange(len(pieces))
        outputs = np.zeros(len(data) + len(pieces), dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[np.searchsorted(-sizes[order], -LONG) :]
        falling = -sizes[order]
        state = np.zeros(len(order), dtype=np.int64)
        for place in range(-int(falling[0]) if len(order) else 0):
            active = int(np.searchsorted(falling, -place, side="left"))
            at = order[:active]
            to = self._follow(state[:active] << 8 | data[begin[at] + place])
            state[:active] = to[:, 0]
            outputs[starts[at] + place] = to[:, 1]
        outputs[starts[order] + sizes[order]] = self.final.data[state]
        first, size = self.first.data[outputs], self.size.data[outputs]
        tokens = self.flat.data[spread(first, size)]
        counts = np.add.reduceat(size, starts) if len(pieces) else np.zeros(0, dtype=np.int64)
        long = np.flatnonzero(sizes > LONG).tolist()
        if long:
            cut = np.split(tokens, np.cumsum(counts)[:-1])
            for i in long:
                cut[i] = np.fromiter(chain.from_iterable(self.steps(pieces[i])), dtype=np.int32)
                counts[i] = len(cut[i])
            tokens = np.concatenate(cut)
        return tokens, counts

    def encode(self, data: bytes) -> tuple[int, ...]:
        return tuple(self.encode_all([data])[0].tolist())

    def steps(self, data: Iterable[int]) -> Iterator[tuple[int, ...]]:
        """What each byte emits (tokens on which all open cuts agree), and at the end what was held back."""
        state, key = 0, np.zeros(1, dtype=np.int64)
        for byte in data:
            key[0] = state << 8 | byte
            state, out = self._follow(key)[0].tolist()
            yield self.output_of[out]
        yield self.output_of[self.final.data[state]]


class Encoder:
    """Whole texts to token ids; pieces are cut by pattern and encoded separately.

    Of texts cut by public_tokenizers.PATTERN: a space between two characters that aren't white
    space always begins a piece, so the chunks between such spaces are encoded separately. Each
    string met has a place, its tokens lie in one array, and a batch's ids are taken from there.
    """

    #: A space beside other white space or at an end of the text.
    odd_space = regex.compile(r"(?:\A|[\s\x1c-\x1f])\x20|\x20(?:[\s\x1c-\x1f]|\Z)")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = MergeTransducer(ranks)
        self.pieces = regex.compile(pattern)
        self.chunked = pattern == public_tokenizers.PATTERN
        self._restart()

    def _restart(self) -> None:
        self.store = Store()
        self.piece, self.plain, self.spaced = (Places(self.store) for _ in range(3))

    def _places(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int64)
        if not self.chunked or self.odd_space.search(text):
            return self.piece.of(self.pieces.findall(text))
        chunks = text.split(" ")
        out = np.empty(len(chunks), dtype=np.int64)
        out[0] = self.plain[chunks[0]]
        out[1:] = self.spaced.of(chunks[1:])
        return out

    def _learn(self) -> None:
        """Gives the fresh strings their tokens."""
        chunks, chunk_places, cut = [], [], []
        spaced, places = self.spaced.taken()
        if spaced:
            found = self.pieces.findall(" " + " ".join(spaced))
            cut.append(self.piece.of(found))
            begins = np.flatnonzero(np.fromiter((p[0] == " " for p in found), dtype=bool, count=len(found)))
            chunks.append(np.diff(begins, append=len(found)))
            chunk_places.append(places)
        plain, places = self.plain.taken()
        if plain:
            found = [self.pieces.findall(c) for c in plain]
            cut.append(np.fromiter((self.piece[p] for x in found for p in x), dtype=np.int64))
            chunks.append(np.array([len(x) for x in found]))
            chunk_places.append(places)
        fresh, places = self.piece.taken()
        if fresh:
            self.store.put(places, *self.machine.encode_all([p.encode("utf-8") for p in fresh]))
        if chunks:
            cut, n = np.concatenate(cut), np.concatenate(chunks)
            tokens, ends = self.store.take(cut, np.concatenate([[0], np.cumsum(n)]))
            self.store.put(np.concatenate(chunk_places), tokens, np.diff(ends))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other (int32), and where each text's begin (one more)."""
        if self.store.full(MAX_PLACES, MAX_KEPT):
            self._restart()
        places = [self._places(t) for t in texts]
        self._learn()
        return self.store.take_lists(places)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """The UTF-8 machine. A state is (continuation bytes due, lowest and highest next byte); None: an error."""
    due, low, high = state
    if due:
        return (due - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return START
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


START = (0, 0, 0)


class StreamDecoder:
    """Token ids to text, token by token. A character that is cut between tokens waits for its rest.

    Bytes that aren't UTF-8 become U+FFFD, one for each maximal part of a character.
    """

    def __init__(self, spelled: dict[int, bytes]):
        self.spelled = spelled
        self.arcs: dict[tuple, tuple] = {}
        top = max(spelled, default=-1) + 1
        self.bytes = pa.array([spelled.get(i) for i in range(top)], type=pa.binary())
        self.sizes = np.array([len(spelled.get(i, b"")) for i in range(top)], dtype=np.int64)
        #: Tokens that begin or end within a character.
        self.partial = np.ones(top, dtype=bool)
        for token, data in spelled.items():
            if data.isascii():
                self.partial[token] = False
            else:
                (state, begun), _, fine = self._run((START, b""), data)
                self.partial[token] = state != START or begun != b"" or not fine
        #: Whether runs of such tokens make whole characters.
        self.whole: dict[bytes, bool] = {}

    @staticmethod
    def _run(start: tuple, data: bytes) -> tuple[tuple, str, bool]:
        (state, begun), out, fine = start, [], True
        for byte in data:
            after = utf8_step(state, byte)
            if after is None:
                fine = False
                if begun:
                    out.append("�")
                    begun, after = b"", utf8_step(START, byte)
                if after is None:
                    out.append("�")
                    state, begun = START, b""
                    continue
            begun += bytes((byte,))
            state = after
            if state[0] == 0:
                out.append(begun.decode("utf-8"))
                state, begun = START, b""
        return (state, begun), "".join(out), fine

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state = (START, b"")
        for token in ids:
            arc = self.arcs.get((state, token))
            if arc is None:
                if len(self.arcs) > 200_000:
                    self.arcs.clear()
                arc = self.arcs[state, token] = self._run(state, self.spelled[token])
            state = arc[0]
            yield arc[1]
        if state[1]:
            yield "�"

    def _makes_whole(self, run: np.ndarray) -> bool:
        key = run.tobytes()
        found = self.whole.get(key)
        if found is None:
            if len(self.whole) > 200_000:
                self.whole.clear()
            state, fine = (START, b""), True
            for token in run.tolist():
                state, _, right = self._run(state, self.spelled[token])
                fine &= right
            found = self.whole[key] = fine and state == (START, b"")
        return found

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes that the ids of all texts spell, and where each text's begin (one more).

        Tokens of whole characters pass the machine at its start. It is run over each run of others; a
        text with one that isn't UTF-8 is streamed.
        """
        data = memoryview(pc.take(self.bytes, pa.array(ids)).buffers()[2] or b"")
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends]
        odd = np.flatnonzero(self.partial[ids])
        if len(odd):
            text = np.searchsorted(ends, odd, side="right")
            cut = np.flatnonzero((np.diff(odd) > 1) | (np.diff(text) > 0)) + 1
            first, last = odd[np.concatenate([[0], cut])], odd[np.concatenate([cut - 1, [len(odd) - 1]])]
            broken = {int(t) - 1 for i, j, t in zip(first.tolist(), last.tolist(), text[np.concatenate([[0], cut])].tolist(), strict=True) if not self._makes_whole(ids[i : j + 1])}
            if broken:
                parts = ["".join(self.stream(ids[ends[t] : ends[t + 1]].tolist())).encode("utf-8") if t in broken else bytes(data[at[t] : at[t + 1]]) for t in range(len(ends) - 1)]
                return memoryview(b"".join(parts)), np.cumsum([0, *map(len, parts)])
        return data[: int(at[-1])], at

    def decode(self, ids: Iterable[int]) -> str:
        found = np.array(list(ids), dtype=np.int64)
        return bytes(self.decode_batch(found, np.array([0, len(found)]))[0]).decode("utf-8")


class Decimals:
    """Ids as decimal strings, each followed by a comma: fixed width, filled up with zero bytes."""

    def __init__(self, top: int):
        width = len(str(top)) + 1
        self.table = np.array([b"%d," % i for i in range(top)], dtype=f"S{width}")
        self.sizes = np.array([len(str(i)) + 1 for i in range(top)], dtype=np.int64)

    def digests(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """For each text the SHA-256 of its decimal ids joined by commas."""
        data = memoryview(self.table[ids].tobytes().translate(None, b"\0"))
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])[ends].tolist()
        return [hashlib.sha256(data[i : max(i, j - 1)]).hexdigest() for i, j in zip(at, at[1:])]


_codecs: dict[tuple, tuple[Encoder, StreamDecoder, Decimals]] = {}


def forget() -> None:
    _codecs.clear()


def codec(path: str, pattern: str) -> tuple[Encoder, StreamDecoder, Decimals]:
    """An encoder, a decoder and a table of decimals, kept for the life of the worker."""
    key = (os.path.realpath(path), pattern)
    if key not in _codecs:
        encoder = Encoder(read_ranks(path), pattern)
        spelled = encoder.machine.spelled
        _codecs[key] = encoder, StreamDecoder(spelled), Decimals(max(spelled) + 1)
    return _codecs[key]
