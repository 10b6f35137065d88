"""Operator 9: benchmark decontamination by SimHash over item-sized windows.

For each benchmark item, windows of its own number of words slide over each text (over the
whole text, if that is shorter). A window's fingerprint has a bit for each of 128 random
signs, summed over its words. Fingerprints at most RADIUS bits from an item's are found by
multi-index blocks: of 8 blocks of 16 bits, at least one differs in at most RADIUS // 8 bits
(pigeonhole), and for each block a table lists the items for every value that near. So no
fingerprint within the radius is missed. A candidate is verified by the weighted Jaccard
similarity of five-word shingles, weights being counts: sum of the least over sum of the
greatest counts. 0.8 and more is contamination.

Windows that share no shingle with an item have similarity 0 with it, so only windows that
hold a shingle of an item of their size are fingerprinted; that loses nothing.

The benchmark is dealt into files of BLOCK items at most, with their shingles, in the shared
folder. One pass over the texts does for any number of items: a task reads all files' shingles
(28 to 44 bytes each) into a sieve, which tells the blocks that a text may match, and makes those
blocks' indexes when first needed; KEPT of them stay. Texts are not shuffled and nothing is
kept of a text but its matches. Word overlap is what decides, so RADIUS is far above what
windows of similarity 0.8 need (they differ in a word or two of fifteen or more).

Null or empty texts match nothing, null or empty items are left out. Of several windows of a
text that match an item, the most similar counts, then the first. Repeated documents are
reported each; repeated items, by item_id, once.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .shingles import PLACES, WIDTH, forget, mixed, shingles, word_hashes

BITS, BLOCKS, RADIUS = 128, 8, 36
#: Items in an index, and indexes that a worker keeps.
BLOCK, KEPT = 512, 6
THRESHOLD = 0.8


def signs(hashes: np.ndarray) -> np.ndarray:
    """For each word 128 signs, +1 or -1."""
    both = np.stack([mixed(hashes ^ np.uint64(0x51D1)), mixed(hashes ^ np.uint64(0xC0DE))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def fingerprints(hashes: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
    """For the windows of so many words at the starts: 8 blocks of 16 bits."""
    low = int(starts[0])
    sums = np.zeros((int(starts[-1]) + length - low + 1, BITS), dtype=np.int32)
    np.cumsum(signs(hashes[low : int(starts[-1]) + length]), axis=0, out=sums[1:])
    at = starts - low
    return np.packbits(sums[at + length] - sums[at] > 0, axis=1).view(np.uint16)


def weighted(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, each values (ascending) and counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of so many words, fewer than a shingle has."""
    last = len(hashes) - size + 1
    return mixed(sum(hashes[i : i + last] * PLACES[i] for i in range(size)))


class ItemIndex:
    """Shingles, lengths and multi-index tables of a block of items."""

    def __init__(self, items: list[tuple]):
        split = [(i, common.words(text)) for i, text in items]
        split = [(i, w) for i, w in split if w]
        self.ids = [i for i, _ in split]
        self.bags = [np.unique(shingles(w), return_counts=True) for _, w in split]
        self.lengths = np.array([len(w) for _, w in split], dtype=np.int64)
        n = len(split)
        owned = [(s, int(k)) for k, (values, _) in zip(self.lengths, self.bags, strict=True) for s in values]
        self.known = np.unique(np.array([s for s, _ in owned], dtype=np.uint64)) if owned else np.empty(0, np.uint64)
        #: For each known shingle the lengths of items that have it.
        self.sizes: dict[int, set[int]] = {}
        for s, k in owned:
            self.sizes.setdefault(int(s), set()).add(k)
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        #: Items of fewer words than a shingle: by length, the hashes of their words in order.
        self.short: dict[int, np.ndarray] = {}
        for _, w in split:
            if len(w) < WIDTH:
                self.short[len(w)] = np.append(self.short.get(len(w), np.empty(0, np.uint64)), runs(word_hashes(w), len(w)))
        lanes = max(1, math.ceil(n / 64))
        self.prints = np.zeros((n, BLOCKS), dtype=np.uint16)
        self.tables = np.zeros((BLOCKS, 1 << 16, lanes), dtype=np.uint64)
        flips = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), r)], dtype=np.uint16)
        for k, (_, w) in enumerate(split):
            self.prints[k] = fingerprints(word_hashes(w), len(w), np.array([0]))[0]
            for b in range(BLOCKS):
                self.tables[b, self.prints[k, b] ^ flips, k // 64] |= np.uint64(1 << (k % 64))
        self.of_length = {int(k): np.flatnonzero(self.lengths == k) for k in set(self.lengths.tolist())}

    def near(self, prints: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items whose fingerprints differ in at most RADIUS bits, looked up by blocks."""
        found = np.zeros((len(prints), self.tables.shape[2]), dtype=np.uint64)
        for b in range(BLOCKS):
            found |= self.tables[b, prints[:, b]]
        listed = (found[:, items // 64] >> (items % 64).astype(np.uint64)) & np.uint64(1)
        w, k = np.nonzero(listed)
        k = items[k]
        apart = np.bitwise_count(prints[w] ^ self.prints[k]).sum(axis=1)
        near = apart <= RADIUS
        return w[near], k[near]

    def match(self, words: list[bytes], whole: np.ndarray | None = None) -> dict:
        """item id: (similarity, first word, number of words), for items that the text contains; whole: its shingles."""
        n = len(words)
        if not n or not self.ids:
            return {}
        found: dict = {}
        hashes = None
        whole = shingles(words) if whole is None else whole
        likely = np.flatnonzero(self.sieve[(whole & np.uint64((1 << 20) - 1)).astype(np.int64)])
        likely = likely[np.isin(whole[likely], self.known)]
        at_of: dict[int, list[int]] = {}
        for p in likely.tolist():
            for size in self.sizes[int(whole[p])]:
                at_of.setdefault(size, []).append(p)
        starts_of: dict[int, list[np.ndarray]] = {}
        for size, at in at_of.items():
            # windows that hold one of the shingles: where more intervals of starts have begun than ended
            window, at = min(size, n), np.array(at)
            cover = np.zeros(n - window + 2, dtype=np.int32)
            first, last = np.maximum(0, at - max(window - WIDTH, 0)), np.minimum(at, n - window)
            some = first <= last
            np.add.at(cover, first[some], 1)
            np.add.at(cover, last[some] + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover) > 0)
            if len(starts):
                starts_of[size] = [starts]
        for size, wanted in self.short.items():
            if n >= size:
                hashes = word_hashes(words) if hashes is None else hashes
                same = np.flatnonzero(np.isin(runs(hashes, size), wanted))
                if len(same):
                    starts_of.setdefault(size, []).append(same)
        for size, parts in starts_of.items():
            hashes = word_hashes(words) if hashes is None else hashes
            window, starts = min(size, n), np.unique(np.concatenate(parts))
            # windows far apart are fingerprinted separately
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * window) + 1):
                w, k = self.near(fingerprints(hashes, window, run), self.of_length[size])
                for start, item in zip(run[w].tolist(), k.tolist(), strict=True):
                    part = whole[start : start + window - WIDTH + 1] if window >= WIDTH else shingles(words[start : start + window])
                    alike = weighted(np.unique(part, return_counts=True), self.bags[item])
                    best = found.get(self.ids[item])
                    if alike >= THRESHOLD and (best is None or (-alike, start) < (-best[0], best[1])):
                        found[self.ids[item]] = (alike, start, window)
        return found


class Library:
    """All files of items: a sieve of their shingles, and indexes of the blocks that texts have hit."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names
        self.blocks: OrderedDict[int, ItemIndex] = OrderedDict()
        known, short = [], {}
        for b, name in enumerate(names):
            found = common.read_arrow(folder, name, ["shingles", "n_words", "short"])
            values = np.unique(found.column("shingles").combine_chunks().flatten().to_numpy().view(np.uint64))
            known.append((values, np.full(len(values), b, dtype=np.int32)))
            for size, run in zip(found.column("n_words").to_pylist(), found.column("short").to_pylist(), strict=True):
                if size < WIDTH:
                    short.setdefault(size, []).append((np.int64(run).view(np.uint64), b))
        values = np.concatenate([v for v, _ in known]) if known else np.empty(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.known = values[order]
        self.owner = (np.concatenate([o for _, o in known]) if known else np.empty(0, np.int32))[order]
        #: By length, runs of items of fewer words than a shingle, ascending, and their blocks.
        self.short = {size: tuple(map(np.array, zip(*sorted(x)))) for size, x in short.items()}
        self.mask = np.uint64((1 << max(16, len(values).bit_length() + 4)) - 1)
        self.sieve = np.zeros(int(self.mask) + 1, dtype=bool)
        self.sieve[(self.known & self.mask).astype(np.int64)] = True

    def block(self, b: int) -> ItemIndex:
        if b not in self.blocks:
            found = common.read_arrow(self.folder, self.names[b], ["item_id", "text"])
            while len(self.blocks) >= KEPT:
                self.blocks.popitem(last=False)
            self.blocks[b] = ItemIndex(list(zip(found.column("item_id").to_pylist(), found.column("text").to_pylist(), strict=True)))
        self.blocks.move_to_end(b)
        return self.blocks[b]

    @staticmethod
    def _owners(values: np.ndarray, known: np.ndarray, owner: np.ndarray) -> set[int]:
        low, high = np.searchsorted(known, values, "left"), np.searchsorted(known, values, "right")
        out: set[int] = set()
        for i, j in {(i, j) for i, j in zip(low.tolist(), high.tolist()) if i < j}:
            out.update(owner[i:j].tolist())
        return out

    def match(self, words: list[bytes]) -> dict:
        if not words or not self.names:
            return {}
        whole = shingles(words)
        likely = whole[self.sieve[(whole & self.mask).astype(np.int64)]]
        hit = self._owners(likely, self.known, self.owner) if len(likely) else set()
        for size, (values, owner) in self.short.items():
            if len(words) >= size:
                hit |= self._owners(runs(word_hashes(words), size), values, owner)
        found: dict = {}
        for b in sorted(hit):
            found |= self.block(b).match(words, whole)
        return found


_libraries: dict[str, Library] = {}


def _library(folder: str, names: list[str]) -> Library:
    if folder not in _libraries:
        _libraries.clear()
        _libraries[folder] = Library(folder, names)
    return _libraries[folder]


def forget_index() -> None:
    _libraries.clear()
    forget()


def item_files(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> tuple[str, list[str]]:
    """A shared folder of the items' files, and their names (one for up to BLOCK items).

    Rows of one item are in one task, and in one file unless they are more than BLOCK.
    """
    folder = common.shared_path(benchmark.sparkSession, "items")
    kind = to_arrow_type(benchmark.schema[key].dataType)
    items = benchmark.select(F.col(key).alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL").dropDuplicates()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for rows in common.smaller(batches, BLOCK):
            split = [common.words(t) for t in rows.column(1).to_pylist()]
            some = rows.filter(pa.array([bool(w) for w in split], pa.bool_()))
            split = [w for w in split if w]
            if not split:
                continue
            table = pa.table({
                "item_id": some.column(0).cast(kind), "text": some.column(1),
                "shingles": pa.array([shingles(w).view(np.int64) for w in split], pa.list_(pa.int64())),
                "n_words": pa.array([len(w) for w in split], pa.int64()),
                "short": pa.array([int(runs(word_hashes(w), len(w)).view(np.int64)[0]) if len(w) < WIDTH else 0 for w in split], pa.int64()),
            })
            made.append(f"items-{TaskContext.get().partitionId():08d}-{len(made):06d}.arrow")
            common.write_arrow(folder, made[-1], table)
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["name"])

    n = max(1, math.ceil(items.count() / BLOCK))
    return folder, sorted(r.name for r in items.repartition(n, "item_id").sortWithinPartitions("item_id", "text").mapInArrow(run, "name string").collect())


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: a row for each text and item that it contains."""
    kind = benchmark.schema[item].dataType
    folder, names = item_files(benchmark, item, item_text)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("item_id", kind), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    arrow = to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("decontaminate", forget_index)
        library = _library(folder, names)
        for rows in common.smaller(batches):
            at, made = [], []
            for i, value in enumerate(rows.column(1).to_pylist()):
                for found, (alike, start, window) in library.match(common.words(value)).items():
                    at.append(i)
                    made.append((found, alike, start, window))
            types = (arrow, pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), *(pa.array([m[c] for m in made], t) for c, t in enumerate(types))], names=[f.name for f in schema])

    return common.arrow_rows(df, [key, text]).mapInArrow(run, schema)


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """df without the rows whose text contains an item. Rows go through Python whole; nothing is shuffled."""
    at = df.columns.index(text)
    folder, names = item_files(benchmark, item, item_text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("decontaminate", forget_index)
        library = _library(folder, names)
        for rows in common.smaller(batches):
            keep = [not library.match(common.words(value)) for value in rows.column(at).to_pylist()]
            yield rows.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_decontamination: every document and benchmark item that it contains."""
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
