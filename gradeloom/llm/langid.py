"""Operator 6: language identification by language-bitmask n-gram filters.

Learning counts byte n-grams (of 3 and 4 bytes, letters only, a word's edge as a space) by
language over all training texts, grouped before they are shuffled. An n-gram belongs to
each language in which it makes up at least RARE of all n-grams; so a language has at most
1 / RARE of them and the filter's size does not depend on the corpus.

The filter is a bit-sliced Bloom filter: a table of bit masks, a bit for each language. An
n-gram's mask is the AND of the masks at its HASHES places, so one look-up tells all
languages that contain it. The hits of a text are counted by language (its popcounts) and
freed of expected false positives: a language whose bits are set in a share f of places
answers falsely with probability p = f ** HASHES, so (hits - p n) / (1 - p) of n n-grams are
true ones on average. The language with the most wins, ties going to the first by name; the
score is its share of all n-grams, between 0 and 1.

Null texts and texts without a letter are ``und`` with score 0; so are all if no label was
learned. Repeated rows count as often as they occur. Source and id are never used.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Least share of a language's n-grams, and the size of the filter.
RARE, PLACES, HASHES = 1e-5, 1 << 21, 2
#: Languages in a word of a mask; more take more words.
WORD = 64
UNKNOWN = "und"
#: N-grams that a task gathers before it counts them.
WAITING = 6_000_000

LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters becomes a space.
LETTERS_ONLY = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers, those of 3 bytes and those of 4, without inner spaces."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(LETTERS_ONLY) + b" ", dtype=np.uint8)
    word = b != 0x20
    wide = b.astype(np.uint32)
    pair = wide[:-1] << np.uint32(8) | wide[1:]
    three = (pair[:-1] << np.uint32(8) | wide[2:])[word[1:-1]]
    four = (pair[:-2] << np.uint32(16) | pair[2:])[word[1:-2] & word[2:-1]]
    return np.concatenate([three, four])


def places(found: np.ndarray) -> tuple[np.ndarray, ...]:
    shift = np.uint64(64 - (PLACES.bit_length() - 1))
    wide = found.astype(np.uint64)
    return tuple(((wide + np.uint64(1)) * np.uint64(m)) >> shift for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[:HASHES])


@dataclass
class Filter:
    """languages, ascending; masks: for each WORD of them a bit mask for each place; false: each one's rate of false hits."""

    languages: list[str]
    masks: list[np.ndarray]
    false: np.ndarray

    def __post_init__(self) -> None:
        few = len(self.languages) <= 8
        self.bits = ((np.arange(256)[:, None] >> np.arange(len(self.languages))) & 1).astype(np.int64) if few else None

    def hits(self, found: np.ndarray) -> np.ndarray:
        """By language, how many of the n-grams are in the filter."""
        at, out = places(found), []
        for masks in self.masks:
            mask = masks[at[0]]
            for other in at[1:]:
                mask = mask & masks[other]
            if self.bits is not None:
                return np.bincount(mask, minlength=256) @ self.bits
            out += [int(np.count_nonzero(mask >> np.uint64(i) & np.uint64(1))) for i in range(min(WORD, len(self.languages) - len(out)))]
        return np.array(out)

    def decide(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        found = grams(text)
        if not len(found):
            return self.languages[0], 0.0
        share = (self.hits(found) / len(found) - self.false) / (1 - self.false)
        best = int(np.argmax(share))
        return self.languages[best], float(min(1.0, max(0.0, share[best])))


def build(entries: Iterable[tuple[str, np.ndarray]]) -> Filter:
    """A filter of languages and their n-grams."""
    entries = sorted(entries, key=lambda e: e[0])
    words = [entries[i : i + WORD] for i in range(0, len(entries), WORD)] or [[]]
    masks, false = [], np.zeros(len(entries))
    for w, some in enumerate(words):
        mask = np.zeros(PLACES, dtype=np.uint8 if len(entries) <= 8 else np.uint64)
        for i, (_, found) in enumerate(some):
            bit = mask.dtype.type(1 << i)
            for at in places(found):
                mask[at] |= bit
            false[w * WORD + i] = (np.count_nonzero(mask & bit) / PLACES) ** HASHES
        masks.append(mask)
    return Filter([name for name, _ in entries], masks, false)


def count_grams(df: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """lang, gram, n over all rows with a text and a label."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("langid", lambda: None)
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def settle() -> None:
            for name, parts in waiting.items():
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                if name in total:
                    found, inverse = np.unique(np.concatenate([total[name][0], found]), return_inverse=True)
                    n = np.bincount(inverse, weights=np.concatenate([total[name][1], n])).astype(np.int64)
                total[name] = found, n
            waiting.clear()

        for rows in common.smaller(batches):
            for name, value in zip(rows.column(1).to_pylist(), rows.column(0).to_pylist(), strict=True):
                found = grams(value)
                waiting.setdefault(name, []).append(found)
                size += len(found)
            if size > WAITING:
                settle()
                size = 0
        settle()
        for name, (found, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text: str = "text", label: str = "lang") -> Filter:
    """A filter from all rows of df. The driver gets at most 1 / RARE n-grams of each language."""
    counts = common.shared_table(count_grams(df, text, label), "grams")
    totals = counts.groupBy("lang").agg((F.sum("n") * RARE).alias("least"))
    kept = counts.join(totals, "lang").where("n >= least").select("lang", "gram").toPandas()
    return build((name, part.gram.to_numpy().astype(np.uint32)) for name, part in kept.groupby("lang"))


def identify(df: DataFrame, model: Filter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score: one row for each of df."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("langid", lambda: None)
        for rows in common.smaller(batches):
            told = [held.value.decide(t) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([n for n, _ in told], pa.string()), pa.array([s for _, s in told], pa.float64())], names=[key, "lang_pred", "score"])

    return common.arrow_rows(df, [key, text]).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, lang_pred string, score double")


def keep_known(df: DataFrame, model: Filter, least: float = 0.1, text: str = "text", label: str | None = None) -> DataFrame:
    """df without the rows that are no text of a learned language: ``und``, or with a score under least.

    If no language was learned, texts with a letter are kept. label: a string column that gets the
    language found where it is null.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)
    fill = df.columns.index(label) if label else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("langid", lambda: None)
        for rows in common.smaller(batches):
            texts = rows.column(at).to_pylist()
            told = [held.value.decide(t) for t in texts]
            if held.value.languages:
                kept = [n != UNKNOWN and s >= least for n, s in told]
            else:
                kept = [bool(t and LETTER.search(t)) for t in texts]
            if fill is not None and held.value.languages:
                named = pc.coalesce(rows.column(fill), pa.array([n for n, _ in told], pa.string()).cast(rows.column(fill).type))
                rows = rows.set_column(fill, rows.schema.field(fill), named)
            yield rows.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2


def training_rows(documents: DataFrame) -> DataFrame:
    return documents.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_language_id: doc_id, held_out, lang_pred, score of every document."""
    documents = common.table(spark, sf_dir, "documents")
    told = identify(documents, train(training_rows(documents)))
    return told.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
