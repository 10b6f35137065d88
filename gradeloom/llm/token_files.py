"""Operator 7: token ids of whole texts in files of fixed-width packed ids (``packed``).

Documents are dealt to ranges of doc_id and sorted (one shuffle of the texts); each task
encodes its range and writes files of about FILE_IDS ids, so its memory is bounded. Files
are named by range and place, written under a name of their own and then renamed: a task
that runs twice leaves the same files. The folder is the shared one; files are opened by
pyarrow's file systems from the folder's URI. A small table lists the files with their
numbers of ids, from which each file's first id follows.

Order: doc_id ascending, null ids first, rows of one id by the hash of their text, then by text.
Null text: no tokens but the end. Repeated rows are written each.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .packed import Reader, Writer, width
from .places import Places, Store

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1
#: Ids in a file; words that a worker keeps before it starts over, and their ids.
FILE_IDS, MAX_WORDS, MAX_KEPT = 1 << 22, 500_000, 4_000_000
#: Texts that are encoded together, and about how many bytes of them.
TOGETHER, TOGETHER_BYTES = 1000, 4 << 20
#: Tasks that read files back, at most; each then reads several.
MAX_READERS = 20_000


class WordEncoder:
    """The tokenizers library on whole texts, with what it gave for earlier words kept.

    If the tokenizer's file has the parts of WORDS (white space dropped, lower case, a token that ends
    each word), its pieces never span white space, so the words between are encoded separately: new ones
    in one call of the library for a batch, without its normaliser where words are normal already. With
    any other tokenizer the library gets the texts whole.
    """

    #: White space of Unicode; others that Python splits at are control characters here.
    space = regex.compile(r"\p{White_Space}+")
    controls = regex.compile(r"[\x1c-\x1f]")
    #: A full stop or comma with another mark beside it.
    marks = re.compile(r"[.,](?:[^\w\s]|_)|(?:[^\w\s]|_)[.,]")
    kinds = bytes(ord("a") if chr(b).isalnum() else ord(" ") if chr(b).isspace() else ord("!") for b in range(128)) + bytes(128)
    pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    #: What a tokenizer's file must say for its texts to be cut at white space.
    WORDS = {
        "normalizer": ["NFC", "Replace", "Lowercase"],
        "replaced": "\\s+",
        "pre_tokenizer": ["Split", "ByteLevel"],
        "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
        "suffix": "</w>",
    }
    #: Words in a string that the library gets.
    STRING = 500

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.by_word = self._parts(path) == self.WORDS
        if self.by_word:
            self.ends = np.zeros(self.size, dtype=bool)
            for token, i in vocabulary.items():
                self.ends[i] = token.endswith(self.WORDS["suffix"])
            #: The same merges for words that are normal and cut already.
            self.merges = Tokenizer(self.library.model)
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._restart()

    @staticmethod
    def _parts(path: str) -> dict:
        with open(path, "rb") as f:
            told = json.load(f)
        normal = (told["normalizer"] or {}).get("normalizers", [])
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        regex_of = lambda parts, kind: next((x.get("pattern", {}).get("Regex") for x in parts if x["type"] == kind), None)
        return {
            "normalizer": [x["type"] for x in normal],
            "replaced": regex_of(normal, "Replace"),
            "pre_tokenizer": [x["type"] for x in cuts],
            "split": regex_of(cuts, "Split"),
            "suffix": told["model"].get("end_of_word_suffix"),
        }

    def _restart(self) -> None:
        self.store = Store()
        self.words = Places(self.store)

    def _direct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and each one's number, by the library alone."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum())), sizes

    def _normal(self, words: list[str]) -> list[str]:
        joined = " ".join(words)
        # the tokenizer's lower case is Python's, but for the sigma at the end of a word
        plain = joined.isascii() or ("\u03a3" not in joined and unicodedata.is_normalized("NFC", joined))
        return (joined.lower() if plain else self.library.normalizer.normalize_str(joined)).split(" ")

    def _by_pieces(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """The words, those of letters alone first, with all ids and each one's number; None if they don't add up."""
        joined = " ".join(words)
        letters = list(map(str.isalpha, words))
        if "\u0130" in joined:
            # its lower case is two characters, one of them no letter
            letters = [x and "\u0130" not in w for x, w in zip(letters, words)]
        whole, mixed = list(compress(words, letters)), [w for w, x in zip(words, letters) if not x]
        normal = self._normal(whole) if whole else []
        cut = [self.pieces.findall(w) for w in self._normal(mixed)] if mixed else []
        if len(normal) != len(whole) or len(cut) != len(mixed):
            return None
        every = [*normal, *chain.from_iterable(cut)]
        strings = [" ".join(every[k : k + self.STRING]) for k in range(0, len(every), self.STRING)]
        found = [e.ids for e in self.merges.encode_batch_fast(strings, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=sum(map(len, found)))
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(every) or (len(ends) and ends[-1] != len(ids)):
            return None
        last = np.concatenate([np.ones(len(whole), dtype=np.int64), np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))])
        return whole + mixed, ids, np.diff(np.concatenate([[0], ends])[np.cumsum(np.concatenate([[0], last]))])

    def _learn(self) -> None:
        fresh, places = self.words.taken()
        if not fresh:
            return
        at = dict(zip(fresh, places.tolist(), strict=True))
        joined = " ".join(fresh)
        odd = [w for w in fresh if any(s in w for s in self.special)] if any(s in joined for s in self.special) else []
        plain = fresh if not odd else [w for w in fresh if w not in set(odd)]
        found = self._by_pieces(plain) if plain else None
        if found is None:
            odd = fresh
        else:
            self.store.put(np.fromiter(map(at.__getitem__, found[0]), dtype=np.int64, count=len(plain)), found[1], found[2])
        if odd:
            self.store.put(np.fromiter(map(at.__getitem__, odd), dtype=np.int64, count=len(odd)), *self._direct(odd))

    def alone(self, text: str) -> bool:
        """No full stop or comma has another mark beside it (or the text is ASCII and no two marks touch)."""
        if text.isascii():
            return b"!!" not in text.encode().translate(self.kinds)
        return not self.marks.search(text)

    def split(self, text: str) -> list[str]:
        lowered = not ("\u03a3" in text or any(s in text for s in self.special))
        text = text.lower() if lowered else text
        if not text.isprintable() and self.controls.search(text):
            return [x for x in self.space.split(text) if x]
        if lowered and self.alone(text):
            # a mark that has no other beside it is a piece by itself
            text = text.replace(".", " . ").replace(",", " , ")
        return text.split()

    def encode(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, and the end id if there is one."""
        last = np.array([] if end is None else [end], dtype="<u4")
        if not self.by_word:
            ids, sizes = self._direct(texts)
            return [np.concatenate([x.astype("<u4"), last]) for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []
        if self.store.full(MAX_WORDS, MAX_KEPT):
            self._restart()
        places = [self.words.of(self.split(t)) for t in texts]
        self._learn()
        ids, ends = self.store.take_lists(places)
        ids = ids.astype("<u4")
        return [np.concatenate([ids[i:j], last]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Writes the files; returns their list: name, n_ids, part, place and first (ids in files before)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone("tokens", _encoders.clear)
        words = encoder(tokenizer)
        part, place, bits = TaskContext.get().partitionId(), 0, width(words.size)
        out, made = Writer(bits), []

        def close() -> None:
            nonlocal out, place
            if out.docs:
                name = f"part-{part:08d}-{place:06d}.glpk"
                common.put_file(folder, name, out.finish())
                made.append((name, out.starts[-1], part, place))
                out, place = Writer(bits), place + 1

        for some in common.portions(batches, 1, TOGETHER, TOGETHER_BYTES):
            for doc, ids in zip(some.column(0).to_pylist(), words.encode([t or "" for t in some.column(1).to_pylist()], end), strict=True):
                out.add(doc, ids)
                if out.starts[-1] >= FILE_IDS:
                    close()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), *(pa.array([m[c] for m in made], pa.int64()) for c in (1, 2, 3))], names=["name", "n_ids", "part", "place"]
        )

    # rows of one id, or of none, are dealt by their texts' hash, so that they are no hot range
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ordered = (
        df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
        .repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    )
    listed = common.shared_table(ordered.mapInArrow(run, "name string, n_ids long, part long, place long"), "files")
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, unpacked from the listed files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = common.store_of(folder)
        for rows in batches:
            for name, first in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}") as f:
                    packed = Reader(f.read_buffer())
                sums = [zlib.crc32(packed.document(k).tobytes()) for k in range(packed.n_docs)]
                starts = packed.starts.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(packed.docs, pa.int64()), pa.array(starts[:-1] + first), pa.array(np.diff(starts)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # the list is small, so it is dealt to a stated number of tasks: about a file to each
    listed = files.select("name", "first")
    dealt = listed.repartition(max(1, min(listed.count(), MAX_READERS)), "name")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_token_files: doc_id, start, n_tokens, ids_crc32 as read back from the files."""
    folder = common.shared_path(spark, "token-files")
    return read(write(common.table(spark, sf_dir, "documents"), folder), folder)
