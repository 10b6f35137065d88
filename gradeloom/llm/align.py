"""Operator 13: alignment of two tokenizers' tokens by an event sweep.

A encodes a space and the text by byte-level BPE, B the text by a piece model that adds the space
itself. A token's event is its end. Both tokenizers' events go, packed by STRETCH bytes of
text, into one stream that is repartitioned by document and sorted by offset in partitions; a
machine with a constant state reads it: how far each side is beyond the last cut, and the
tokens of the open group. Where both sides end, the group is closed: all its A tokens are
linked with all its B tokens. Only ids are shuffled, as offsets follow from the tokens' lengths.

What a document holds linked is kept as distinct id pairs with their numbers of links. Documents
a pair are counted after a sum within each task. Pairs as frequent as the HOT commonest are looked
up in the tasks (the table's size is bounded by HOT, chosen by a histogram of counts); all
others, and the pairs of documents that hold very many, are joined.

Null and empty texts, and texts that A's or B's tokens do not spell (B reads U+2581 as a space), have no
tokens, no groups and an empty digest. Repeated rows are documents each, ids may be null or
repeat. The rows must come the same if they are read again, as those of files do.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .places import Places, Store, spread

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
STRETCH = 1 << 16
#: Texts that are encoded together and their bytes; events' bytes that are swept together.
TOGETHER, TOGETHER_BYTES, SWEPT_BYTES = 1024, 4 << 20, 1 << 20
#: Strings that a worker keeps before it starts over, and their ids.
MAX_PLACES, MAX_KEPT = 500_000, 4_000_000
#: Links of a group that are written out at once; distinct pairs of a group, and of a document, that stay in its row.
SMALL, LARGE, HELD = 256, 1 << 16, 1 << 20
#: Pairs that every task can look up; codes that are counted before they leave a task.
HOT, COUNTED = 1 << 20, 1 << 22


class Tokens:
    """Ids and byte lengths of both tokenizers, by strings that were met before.

    A space between two characters that aren't white space begins a piece of A and of B, so a text
    whose spaces are all such is encoded by the chunks between; other texts by A's pieces and by
    B's runs of spaces with what follows. Each string has a place, its ids lie in flat arrays.
    """

    odd_space = regex.compile(r"(?:\A|[\s\x1c-\x1f])\x20|\x20(?:[\s\x1c-\x1f]|\Z)")
    pieces = regex.compile(public_tokenizers.PATTERN)
    runs = regex.compile(r" [ ]*(?:[^ ]+|\Z)")

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        spelled = spelled_by_a(self.a)
        self.b_bytes = spelled_by_b(self.b)
        self.lengths = (np.zeros(max(spelled) + 1, dtype=np.int64), np.array([len(x) for x in self.b_bytes], dtype=np.int64))
        for i, x in spelled.items():
            self.lengths[0][i] = len(x)
        self.space = self.b.piece_to_id("▁")
        self.restart()

    def restart(self) -> None:
        self.stores = (Store(), Store())
        self.chunk, self.piece, self.run = (Places(self.stores[0]) for _ in range(3))
        self.bad: set[int] = set()

    def _put_a(self, strings: list[str], places: np.ndarray) -> None:
        if strings:
            found = [e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))
            self.stores[0].put(places, ids, sizes)
            told = np.diff(np.concatenate([[0], np.cumsum(self.lengths[0][ids])])[np.concatenate([[0], np.cumsum(sizes)])])
            for place, n, s in zip(places.tolist(), told.tolist(), strings, strict=True):
                if n != len(s.encode()):
                    self.bad.add(place)

    def _put_b(self, strings: list[str], places: np.ndarray) -> None:
        """Strings without their first space, which B adds."""
        if strings:
            found = [x if s else [self.space] for s, x in zip(strings, self.b.encode(strings, num_threads=1), strict=True)]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self.stores[1].n = self.stores[0].n
            self.stores[1].put(places, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum())), sizes)
            for place, x, s in zip(places.tolist(), found, strings, strict=True):
                if b"".join(map(self.b_bytes.__getitem__, x)) != b" " + s.encode():
                    self.bad.add(place)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B the ids of all texts and where each one's begin (one more)."""
        if self.stores[0].full(MAX_PLACES, MAX_KEPT):
            self.restart()
        chunked = [bool(t) and not self.odd_space.search(t) for t in texts]
        none = np.zeros(0, dtype=np.int64)
        places_a, places_b = [], []
        for t, simple in zip(texts, chunked, strict=True):
            places_a.append(self.chunk.of(t.split(" ")) if simple else self.piece.of(self.pieces.findall(" " + t)) if t else none)
            places_b.append(places_a[-1] if simple else self.run.of([x[1:] for x in self.runs.findall(" " + t)]) if t else none)
        fresh, places = self.chunk.taken()
        self._put_a([" " + c for c in fresh], places)
        self._put_b(fresh, places)
        self._put_a(*self.piece.taken())
        self._put_b(*self.run.taken())
        for k in range(len(texts)):
            if self.bad and not (self.bad.isdisjoint(places_a[k].tolist()) and self.bad.isdisjoint(places_b[k].tolist())):
                places_a[k] = places_b[k] = none
        self.stores[1].n = self.stores[0].n
        return [store.take_lists(p) for store, p in zip(self.stores, (places_a, places_b), strict=True)]


def spelled_by_a(tokenizer) -> dict[int, bytes]:
    """The bytes of each id of a byte-level vocabulary; a special token's are its string's."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    return {i: bytes(byte_of[c] for c in t) for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if i not in special} | special


def spelled_by_b(model) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, <0xHH> a byte."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


_tokens: dict[tuple[str, str], Tokens] = {}


def tokens(a_path: str, b_path: str) -> Tokens:
    if (a_path, b_path) not in _tokens:
        _tokens[a_path, b_path] = Tokens(a_path, b_path)
    return _tokens[a_path, b_path]


def _packed(n: int) -> np.dtype:
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


EVENTS = ("row", "stretch", "side", "ids")


def events(df: DataFrame, key: str = "doc_id", text: str = "text", a_path: str = A, b_path: str = B, stretch: int = STRETCH) -> DataFrame:
    """row, key, stretch, side, ids: both sides' tokens that end in each stretch of bytes; at least one row a document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("align", _tokens.clear)
        both = tokens(a_path, b_path)
        for rows in common.portions(batches, 2, TOGETHER, TOGETHER_BYTES):
            texts = [t or "" for t in rows.column(2).to_pylist()]
            for side, (ids, ends) in enumerate(both.encode(texts)):
                data = memoryview(ids.astype(_packed(len(both.lengths[side]))).tobytes())
                size = len(data) // max(1, len(ids))
                offsets = np.concatenate([[0], np.cumsum(both.lengths[side][ids])])
                text_of, cuts, number = [], [], []
                for k, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    last = max(0, int(offsets[j] - offsets[i]) - 1) // stretch
                    inner = np.searchsorted(offsets[i + 1 : j + 1] - offsets[i], np.arange(1, last + 1) * stretch, side="right") + i if last else []
                    bounds = [i, *inner, j]
                    for s, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        if y > x or (side == 0 and s == 0):
                            text_of.append(k)
                            cuts.append(bytes(data[x * size : y * size]))
                            number.append(s)
                some = rows.take(pa.array(text_of, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(number, pa.int32()), pa.array(np.full(len(cuts), side), pa.int8()), pa.array(cuts, pa.binary())],
                    names=["row", key, "stretch", "side", "ids"],
                )

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField(key, df.schema[key].dataType), T.StructField("stretch", T.IntegerType()), T.StructField("side", T.ByteType()), T.StructField("ids", T.BinaryType())])
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(key), F.col(text)).mapInArrow(run, schema)


class Decimals:
    """Each id as a decimal string followed by a comma, a bar or a semicolon, filled up with zero bytes."""

    def __init__(self, top: int):
        width = len(str(top)) + 1
        self.table = np.array([b"%d%c" % (i, mark) for i in range(top) for mark in b",|;"], dtype=f"S{width}")
        self.sizes = np.char.str_len(self.table)

    def spell(self, codes: np.ndarray) -> bytes:
        return self.table[codes].tobytes().translate(None, b"\0")


class Open:
    """A document whose events may go on: its sums so far and the tokens of its open group."""

    def __init__(self, row: int, key: object):
        self.row, self.key = row, key
        self.tail = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)]
        self.counts = np.zeros(4, dtype=np.int64)
        self.digest, self.begun, self.text = hashlib.sha256(), False, []
        self.codes, self.times, self.held, self.loose = [], [], 0, False

    def add(self, counts: np.ndarray, text: bytes, codes: np.ndarray, times: np.ndarray, whole: bool) -> None:
        self.counts += counts
        if text:
            if self.begun:
                self.digest.update(b";")
            self.digest.update(text)
            self.begun = True
            if whole:
                self.text.append(text)
        if len(codes):
            self.codes.append(codes)
            self.times.append(times)
            self.held += len(codes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes held, and their links; they are dropped here."""
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, dtype=np.int64)
        times = np.concatenate(self.times) if self.times else np.zeros(0, dtype=np.int64)
        self.codes, self.times, self.held = [], [], 0
        return summed(codes, times)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


class Sweep:
    """Reads the sorted events; gives rows of documents, and of parts of those with very many pairs."""

    def __init__(self, both: Tokens, whole: bool = False):
        self.lengths = both.lengths
        self.base = len(both.lengths[1])
        self.kinds = [_packed(len(x)) for x in both.lengths]
        self.decimals = Decimals(max(map(len, both.lengths)))
        self.whole = whole
        self.open: Open | None = None
        self.out: list[tuple] = []

    def feed(self, rows: np.ndarray, keys: list, sides: np.ndarray, ids: list[bytes]) -> None:
        """Some events in order; documents that are through are put out."""
        if self.open and self.open.row != rows[0]:
            self._close(self.open)
            self.open = None
        begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        n = len(begins)
        doc_of = np.repeat(np.arange(n), np.diff(np.concatenate([begins, [len(rows)]])))
        first = self.open or Open(int(rows[0]), keys[0])
        tail, first.tail = first.tail, [np.zeros(0, dtype=np.int64)] * 2
        token, doc = [], []
        for side in (0, 1):
            at = np.flatnonzero(sides == side)
            some = [ids[i] for i in at.tolist()]
            found = np.frombuffer(b"".join(some), dtype=self.kinds[side]).astype(np.int64)
            sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some)) // self.kinds[side].itemsize
            token.append(np.concatenate([tail[side], found]))
            doc.append(np.concatenate([np.zeros(len(tail[side]), dtype=np.int64), np.repeat(doc_of[at], sizes)]))
        ends = self._ends(token, doc, n)
        # where an end of A is one of B's
        at = np.searchsorted(ends[1], ends[0])
        closes = [np.zeros(len(t), dtype=bool) for t in token]
        inside = at < len(ends[1])
        closes[0][inside] = ends[1][at[inside]] == ends[0][inside]
        closes[1][at[closes[0]]] = True
        groups = int(closes[0].sum())
        group = [np.cumsum(c) - c for c in closes]
        rest = [t[g == groups] for t, g in zip(token, group, strict=True)]
        token, doc, closes, group = ([x[: len(x) - len(r)] for x, r in zip(y, rest, strict=True)] for y in (token, doc, closes, group))
        size = [np.bincount(g, minlength=groups) for g in group]
        begin = [np.cumsum(s) - s for s in size]
        doc_of_group = doc[0][closes[0]]
        links = size[0] * size[1]
        counts = np.stack([np.bincount(doc[0], minlength=n), np.bincount(doc[1], minlength=n), np.bincount(doc_of_group, minlength=n), np.bincount(doc_of_group, weights=links, minlength=n).astype(np.int64)], axis=1)
        spelled, text_at = self._spelled(token, closes, group, size, begin, counts)
        loose: set[int] = set()
        codes, times, code_at = self._pairs(token, size, begin, links, doc_of_group, n, rows[begins], loose)
        for k in range(n):
            one = first if k == 0 else Open(int(rows[begins[k]]), keys[begins[k]])
            one.loose |= k in loose
            one.add(counts[k], spelled[text_at[k] : max(text_at[k], text_at[k + 1] - 1)], codes[code_at[k] : code_at[k + 1]], times[code_at[k] : code_at[k + 1]], self.whole)
            if k < n - 1:
                self._close(one)
            else:
                one.tail = rest
                if one.held > HELD:
                    one.loose = True
                    self._part(one.row, *one.pairs())
                self.open = one

    def _ends(self, token: list[np.ndarray], doc: list[np.ndarray], n: int) -> list[np.ndarray]:
        """Each token's end, documents one after the other."""
        length = [table[t] for table, t in zip(self.lengths, token, strict=True)]
        total = [np.bincount(d, weights=x, minlength=n).astype(np.int64) for d, x in zip(doc, length, strict=True)]
        start = np.cumsum(np.maximum(*total) + 1)
        start = np.concatenate([[0], start[:-1]])
        return [np.cumsum(x) - (np.cumsum(t) - t)[d] + start[d] for x, t, d in zip(length, total, doc, strict=True)]

    def _spelled(self, token: list, closes: list, group: list, size: list, begin: list, counts: np.ndarray) -> tuple[bytes, list[int]]:
        """All groups as text, and where each document's begins (one more)."""
        start = np.cumsum(size[0] + size[1]) - (size[0] + size[1])
        out = np.empty(len(token[0]) + len(token[1]), dtype=np.int64)
        out[start[group[0]] + np.arange(len(token[0])) - begin[0][group[0]]] = token[0] * 3 + closes[0]
        out[(start + size[0])[group[1]] + np.arange(len(token[1])) - begin[1][group[1]]] = token[1] * 3 + 2 * closes[1]
        bytes_at = np.concatenate([[0], np.cumsum(self.decimals.sizes[out])])
        return self.decimals.spell(out), bytes_at[np.concatenate([[0], np.cumsum(counts[:, 0] + counts[:, 1])])].tolist()

    def _pairs(self, token: list, size: list, begin: list, links: np.ndarray, doc: np.ndarray, n: int, rows: np.ndarray, loose: set[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Distinct codes by document with their links, and where each document's begin (one more)."""
        space = len(self.lengths[0]) * self.base
        small = np.flatnonzero(links <= SMALL)
        which = np.repeat(small, links[small])
        at = spread(np.zeros(len(small), dtype=np.int64), links[small])
        a = token[0][begin[0][which] + at // size[1][which]]
        b = token[1][begin[1][which] + at % size[1][which]]
        keys, times = [doc[which] * space + a * self.base + b], [np.ones(len(which), dtype=np.int64)]
        for g in np.flatnonzero(links > SMALL).tolist():
            (a, n_a), (b, n_b) = (np.unique(t[x[g] : x[g] + s[g]], return_counts=True) for t, x, s in zip(token, begin, size, strict=True))
            step = max(1, LARGE // len(b))
            for i in range(0, len(a), step):
                codes, many = (a[i : i + step, None] * self.base + b).ravel(), (n_a[i : i + step, None] * n_b).ravel()
                if len(a) * len(b) <= LARGE:
                    keys.append(doc[g] * space + codes)
                    times.append(many)
                else:
                    loose.add(int(doc[g]))
                    self._part(int(rows[doc[g]]), codes, many)
        found, many = summed(np.concatenate(keys), np.concatenate(times))
        return found % space, many, np.searchsorted(found, np.arange(n + 1) * space).tolist()

    def _part(self, row: int, codes: np.ndarray, times: np.ndarray) -> None:
        self.out.append((row, None, True, True, *[None] * 4, None, None, codes.astype("<i8").tobytes(), times.astype("<i8").tobytes()))

    def _close(self, one: Open) -> None:
        codes, times = one.pairs()
        text = b";".join(one.text).decode() if self.whole else None
        digest = one.digest.hexdigest() if one.begun else ""
        self.out.append((one.row, one.key, False, one.loose, *one.counts.tolist(), digest, text, codes.astype("<i8").tobytes(), times.astype("<i8").tobytes()))

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def end(self) -> None:
        if self.open:
            self._close(self.open)
            self.open = None


def swept(stream: DataFrame, key: str = "doc_id", a_path: str = A, b_path: str = B, whole: bool = False) -> DataFrame:
    """A row of each document: row, key, its counts, digest, groups (if whole), and its distinct pairs packed.

    pairs: codes (A id times B's vocabulary plus B id) and times (links), 64-bit integers. A
    document with very many is loose: parts of its pairs are rows of their own (part is true).
    """
    fields = [T.StructField(key, stream.schema[key].dataType), T.StructField("part", T.BooleanType()), T.StructField("loose", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links"))]
    schema = T.StructType([T.StructField("row", T.LongType()), *fields, T.StructField("groups_sha256", T.StringType()), T.StructField("groups", T.StringType()), T.StructField("codes", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("align", _tokens.clear)
        sweep = Sweep(tokens(a_path, b_path), whole)
        arrow = None

        def given() -> Iterator[pa.RecordBatch]:
            nonlocal arrow
            out = sweep.taken()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), arrow, strict=True)], names=schema.names)

        for some in common.portions(batches, 4, 1 << 14, SWEPT_BYTES):
            arrow = arrow or [pa.int64(), some.schema.field(1).type, pa.bool_(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.binary(), pa.binary()]
            sweep.feed(np.asarray(some.column(0)), some.column(1).to_pylist(), np.asarray(some.column(3)), some.column(4).to_pylist())
            yield from given()
        sweep.end()
        yield from given()

    order = ("row", "stretch", "side")
    return stream.repartition("row").sortWithinPartitions(*order).select("row", key, "stretch", "side", "ids").mapInArrow(run, schema)


def _unpacked(df: DataFrame) -> DataFrame:
    """row, code, times of each pair."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in common.portions(batches, 1, 1 << 14, 8 << 20):
            codes, times, ends = _arrays(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(some.column(0)), np.diff(ends))), pa.array(codes), pa.array(times)], names=["row", "code", "times"])

    return df.select("row", "codes", "times").mapInArrow(run, "row long, code long, times long")


def _arrays(some: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes, times and where each row's begin, of row, codes, times."""
    codes, times = (np.frombuffer(b"".join(some.column(c).to_pylist()), dtype="<i8") for c in ("codes", "times"))
    sizes = np.asarray(some.column("codes").cast(pa.large_binary()).to_numpy(zero_copy_only=False), dtype=object)
    return codes, times, np.concatenate([[0], np.cumsum([len(x) // 8 for x in sizes])]).astype(np.int64)


def loose_pairs(aligned: DataFrame) -> DataFrame:
    """row, code, times of the documents that hold very many pairs, each pair once."""
    return _unpacked(aligned.where("loose")).groupBy("row", "code").agg(F.sum("times").alias("times"))


def pair_counts(aligned: DataFrame, loose: DataFrame, base: int) -> DataFrame:
    """code, n, best: in how many documents a pair is linked, and whether that is its A id's most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def told() -> pa.RecordBatch:
            codes, many = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(many.astype(np.int64))], names=["code", "n"])

        for some in batches:
            held.append(np.frombuffer(b"".join(some.column(0).to_pylist()), dtype="<i8"))
            n += len(held[-1])
            if n > COUNTED:
                yield told()
                held, n = [], 0
        if n:
            yield told()

    packed = aligned.where("NOT loose").select("codes").mapInArrow(run, "code long, n long")
    counts = packed.unionByName(loose.select("code", F.lit(1).cast("long").alias("n"))).groupBy("code").agg(F.sum("n").alias("n"))
    counts = common.shared_table(counts, "counts").withColumn("a", F.expr(f"code div {base}"))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    return common.shared_table(counts.join(best, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def commonest(counts: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Codes, counts and best of the most frequent pairs, no more than hot, and whether these are all."""
    sizes = sorted(((r.power, r["count"]) for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()), reverse=True)
    taken, least = 0, None
    for power, many in sizes:
        if taken + many > hot:
            break
        taken, least = taken + many, power
    if least is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), not sizes
    t = counts.where(F.floor(F.log2("n")) >= least).toArrow()
    code, n, best = (t.column(c).to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(code)
    return code[order], n[order], best[order].astype(bool), taken == sum(m for _, m in sizes)


def summaries(df: DataFrame, key: str = "doc_id", text: str = "text", a_path: str = A, b_path: str = B, hot: int = HOT, stretch: int = STRETCH) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    spark = df.sparkSession
    aligned = common.shared_table(swept(events(df, key, text, a_path, b_path, stretch), key, a_path, b_path), "aligned")
    base = len(tokens(a_path, b_path).lengths[1])
    loose = common.shared_table(loose_pairs(aligned), "loose")
    counts = pair_counts(aligned, loose, base)
    *table, every = commonest(counts, hot)
    held = spark.sparkContext.broadcast(table)

    def places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each code is in the table, and whether it is."""
        known = held.value[0]
        at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
        return at, (known[at] == codes if len(known) else np.zeros(len(codes), dtype=bool))

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in common.portions(batches, 7, 1 << 14, 8 << 20):
            codes, times, ends = _arrays(some)
            at, found = places(codes)
            n, best = (np.where(found, x[at], 0) if len(x) else np.zeros(len(codes), dtype=np.int64) for x in held.value[1:])
            total = [np.diff(np.concatenate([[0], np.cumsum(times * x)])[ends]) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*some.columns[:7], *map(pa.array, total)], names=[*some.schema.names[:7], "hot_best", "hot_sum"])

    def cold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in common.portions(batches, 1, 1 << 14, 8 << 20):
            codes, times, ends = _arrays(some)
            rest = ~places(codes)[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(some.column(0)), np.diff(ends))[rest]), pa.array(codes[rest]), pa.array(times[rest])], names=["row", "code", "times"])

    told = ["row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    empty = F.expr("cast('' as binary)")
    # a loose document's pairs are all joined
    own = aligned.where("NOT part").select(*told, *(F.when(F.col("loose"), empty).otherwise(F.col(c)).alias(c) for c in ("codes", "times")))
    schema = T.StructType([*(own.schema[c] for c in told), T.StructField("hot_best", T.LongType()), T.StructField("hot_sum", T.LongType())])
    documents = own.mapInArrow(sums, schema)
    rest = loose
    if not every:
        rest = loose.unionByName(own.select("row", "codes", "times").mapInArrow(cold, "row long, code long, times long"))
    joined = rest.join(counts, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("rest_best"), F.sum(F.col("times") * F.col("n")).alias("rest_sum"))
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias
    return documents.join(joined, "row", "left").select(key, "n_a", "n_b", "n_groups", "n_links", plus("hot_best", "rest_best")("n_best"), plus("hot_sum", "rest_sum")("count_sum"), "groups_sha256")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", a_path: str = A, b_path: str = B) -> DataFrame:
    """key and groups of each row: ``a1,a2|b1;a3|b2,b3``, empty without tokens."""
    found = swept(events(df, key, text, a_path, b_path), key, a_path, b_path, whole=True)
    return found.where("NOT part").select(key, "groups")


def links(df: DataFrame, key: str = "doc_id", text: str = "text", a_path: str = A, b_path: str = B) -> DataFrame:
    """key, a, b, times: the distinct id pairs that each row holds linked, and its number of such links."""
    aligned = common.shared_table(swept(events(df, key, text, a_path, b_path), key, a_path, b_path), "aligned")
    base = len(tokens(a_path, b_path).lengths[1])
    every = _unpacked(aligned.where("NOT loose")).unionByName(loose_pairs(aligned))
    return every.join(aligned.where("NOT part").select("row", key), "row").select(key, F.expr(f"code div {base}").alias("a"), (F.col("code") % base).alias("b"), "times")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_align: the alignment of every document's tokens."""
    return summaries(common.table(spark, sf_dir, "documents"))
