"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item becomes windows of consecutive words, each window the set of its word shingles. A document
holds a window only if it holds all its shingles, so one shingle is a sufficient prefix: the one that is rarest over all
documents. Documents are joined on these prefix shingles alone; a hit fixes where the window would lie, the
length bound drops it if it would reach over either end of the document, the positional bound ties the shingle to
its offset in the window, and what is left is looked up whole, by all its words, among the windows.

Scale: documents are streamed, never shuffled. The window index is broadcast in blocks of items whose
size is checked (`block_words`; longer items are split); a benchmark of many blocks takes a pass over the documents for each block, and
their hits are then merged by document. Rarity counts are kept for shingles of the benchmark alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import texts

#: Words: runs of 0-9, a-z (A-Z lower-cased) and everything beyond ASCII; all else separates.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Words of a shingle.
SHINGLE = 3
#: Benchmark words of a broadcast block: some 300 bytes each in a worker.
BLOCK_WORDS = 500_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def _among(values: np.ndarray, known: np.ndarray) -> list[int]:
    """Where values are that stand in a sorted array."""
    if not len(known):
        return []
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return np.flatnonzero(known[at] == values).tolist()


class Windows:
    """The windows of a block of items, found by one shingle each. Equal windows are one, whichever items have them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.items, self.window = [name for name, _ in items], window
        self.ids: dict[bytes, int] = {}
        self.words = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int32) for _, words in items]
        self.base = len(self.ids) + 1  # 0: a word of no item
        self.shingles = np.unique(np.concatenate([self.keys(w) for w in self.words])) if self.words else np.empty(0, np.int64)

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """The shingle that starts at each word; past the end of a window or a document there are words 0."""
        padded = np.r_[ids, np.zeros(SHINGLE - 1, ids.dtype)]
        out = np.zeros(len(ids), np.int64)
        for i in range(SHINGLE):
            out = out * self.base + padded[i : i + len(ids)]
        return out

    def known(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or 0."""
        return np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words))

    def count(self, ids: np.ndarray) -> np.ndarray:
        """The places in `shingles` of a document's distinct shingles."""
        keys = np.unique(self.keys(ids)[ids > 0])
        at = np.searchsorted(self.shingles, keys)
        at[at == len(self.shingles)] = 0
        return at[self.shingles[at] == keys] if len(self.shingles) else at[:0]

    def choose(self, documents_with: np.ndarray) -> None:
        """Takes each window's rarest shingle that lies whole within it (of equals the first) as its prefix.

        Of the windows with one prefix only the (offset, length) are kept: fewer than a hundred, however many windows there are.
        """
        chosen: dict[int, set[tuple[int, int]]] = {}
        #: A window's words as bytes -> the item that has it, or a list of them.
        self.owners: dict[bytes, int | list[int]] = {}
        for k, ids in enumerate(self.words):
            if not len(ids):
                continue
            n, raw, keys = min(self.window, len(ids)), ids.tobytes(), self.keys(ids)
            if n < SHINGLE:  # a window without a whole shingle: its first word stands for it
                places, keys = [0], -ids[:1].astype(np.int64)
            else:
                seen = documents_with[np.searchsorted(self.shingles, keys[: len(ids) - SHINGLE + 1])]
                places = np.lib.stride_tricks.sliding_window_view(seen, n - SHINGLE + 1).argmin(axis=1).tolist()
            keys = keys.tolist()
            for i, offset in enumerate(places):
                window = raw[4 * i : 4 * (i + n)]
                own = self.owners.setdefault(window, k)
                if own == k:
                    chosen.setdefault(keys[i + offset], set()).add((offset, n))
                elif not isinstance(own, list):
                    self.owners[window] = [own, k]
                elif own[-1] != k:
                    own.append(k)
        del self.words
        self.prefix = {key: sorted(places) for key, places in chosen.items()}
        self.long = np.array(sorted(k for k in chosen if k >= 0), np.int64)
        self.short = np.array(sorted(-k for k in chosen if k < 0), np.int32)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words of a document are hit, and by which items."""
        hit = np.zeros(len(ids) + 1, np.int64)
        items: set[int] = set()
        if not ids.any():
            return hit[:-1] > 0, items
        keys = self.keys(ids)
        places = [(p, int(keys[p])) for p in _among(keys, self.long)] + [(p, -int(ids[p])) for p in _among(ids, self.short)]
        raw, seen = ids.tobytes(), set()
        for p, key in places:
            for offset, length in self.prefix[key]:
                a, b = p - offset, p - offset + length
                if a < 0 or b > len(ids) or (owners := self.owners.get(raw[4 * a : 4 * b])) is None:
                    continue
                hit[a] += 1
                hit[b] -= 1
                if not isinstance(owners, list):
                    items.add(owners)
                elif id(owners) not in seen:
                    seen.add(id(owners))
                    items.update(owners)
        return np.cumsum(hit[:-1]) > 0, items


def _item_blocks(benchmark: DataFrame, most: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in order of their id as strings, a block in the driver at a time; items without an id or words have no windows."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    parts = (part for r in rows.toLocalIterator() for part in _parts_of(r.item_id, words_of(r.text.encode("utf-8", "surrogatepass")), most, window))
    yield from _blocks_of(parts, most)


def _parts_of(name: str, words: list[bytes], most: int, window: int) -> Iterator[tuple[str, list[bytes]]]:
    """An item in parts of at most `most` words (or a window) that have all its windows between them."""
    most = max(most, window)
    for a in range(0, max(1, len(words) - window + 1), most - window + 1):
        yield name, words[a : a + most]


def _blocks_of(items: Iterator[tuple[str, list[bytes]]], most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    held, size = [], 0
    for item in items:
        if held and size + len(item[1]) > most:
            yield held
            held, size = [], 0
        held.append(item)
        size += len(item[1])
    if held:
        yield held


def _document_counts(documents: DataFrame, windows: Windows) -> np.ndarray:
    """For each shingle of the block the number of documents that have it; sums of at most one row a shingle and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(windows.shingles), np.int64)
        for batch in batches:
            for text in texts(batch.column("text")):
                if text:
                    counts[windows.count(windows.known(words_of(text)))] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["k", "n"])

    rows = documents.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(windows.shingles), np.int64)
    out[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    return out


_MARKS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _marked(documents: DataFrame, benchmark: DataFrame, window: int, block_words: int, keep: list[str]) -> DataFrame:
    """A struct `row` with the columns to keep, and a struct `marks` (n_words, hits, items): a narrow pass for each block of items."""
    blocks = _item_blocks(benchmark, block_words, window)
    out = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    last = T.StructType([T.StructField("row", T.StructType([documents.schema[c] for c in keep])), T.StructField("marks", _MARKS)])
    more = T.StructType([out.schema["row"], T.StructField("marks", _MARKS)])

    def prepared(block: list[tuple[str, list[bytes]]]) -> Windows:
        windows = Windows(block, window)
        windows.choose(_document_counts(documents, windows))
        return windows

    def run(batches: Iterator[pa.RecordBatch], windows: Windows, columns: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            before = batch.column("marks").to_pylist() if "marks" in batch.schema.names else repeat(None)
            marks = []
            for text, old in zip(texts(row.field("text")), before, strict=False):
                words = words_of(text)
                hit, found = windows.find(windows.known(words))
                hits, items = set(np.flatnonzero(hit).tolist()), {windows.items[k] for k in found}
                if old:
                    hits, items = hits.union(old["hits"]), items.union(old["items"])
                marks.append((len(words), sorted(hits), sorted(items)))
            n, hits, items = zip(*marks, strict=True) if marks else [()] * 3
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]
            struct = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip((n, hits, items), kinds, strict=True)], _MARKS.fieldNames())
            kept = pa.StructArray.from_arrays([row.field(c) for c in columns], columns)
            yield pa.RecordBatch.from_arrays([kept, struct], ["row", "marks"])

    def narrow(df: DataFrame, windows: Windows, columns: list[str], schema: T.StructType) -> DataFrame:
        return df.mapInArrow(lambda b: run(b, windows, columns), schema)

    held = next(blocks, [])
    for block in blocks:
        out, held = narrow(out, prepared(held), documents.columns, more), block
    return narrow(out, prepared(held), keep, last)


def contamination(documents: DataFrame, benchmark: DataFrame, *, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, hits (places of the words hit, ascending) and items (ids as strings, sorted) of each row.

    `documents` has doc_id and text, `benchmark` item_id and text. A null, empty or wordless text has no words and no
    hits; an item of no words, or without an id, has no windows. Repeated items count once in `items`; repeated rows of
    `documents` keep a row each. An empty benchmark leaves every document without hits.
    """
    marked = _marked(documents.select("doc_id", "text"), benchmark, window, block_words, ["doc_id"])
    return marked.select("row.doc_id", "marks.n_words", "marks.hits", "marks.items")


def contamination_summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (a word is hit, and at least one in twenty)."""
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, *, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows that are not contaminated, with their own columns: a filter, without a shuffle."""
    marked = _marked(documents, benchmark, window, block_words, documents.columns)
    n_hit = F.size("marks.hits")
    return marked.where(~((n_hit > 0) & (20 * n_hit >= F.col("marks.n_words")))).select("row.*")
