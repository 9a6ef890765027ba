"""Token-ID output: documents encoded to Parquet list columns that can be read in part.

The file format is a folder of Parquet files, in doc_id order across and within files. Columns: doc_id, ids (a
list of int, dictionary-encoded where few values repeat, else delta-encoded), n_tokens, and the
row's place (file_no, local_start). Row groups and pages have a set size and pages carry an index, so a
reader of one doc_id range or of the metadata alone opens only the pages it needs. `read_tokens` adds `start`,
the number of ids of all documents before a document.

Scale: one range shuffle of texts, then encoding within sorted partitions. Starts come from one row for each file.
"""

from __future__ import annotations

import codecs
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose ids a worker remembers; beyond it the memory starts afresh, results stay the same.
MEMO_WORDS = 300_000
#: Words that the library encodes at a time; what it says of each is large.
ASKED_WORDS = 16_384
#: Rows of a file, about.
FILE_ROWS = 100_000
#: Bytes of text that are encoded together; bounds what a worker holds.
BLOCK_BYTES = 4 << 20
_SPACE = bytes.maketrans(b"\t\n\r", b"   ")
_LOWER = bytes.maketrans(b"\t\n\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"   abcdefghijklmnopqrstuvwxyz")
#: A word's end that is a piece of its own if a letter or digit stands before it.
_TAIL = re.compile(rb"[!#$%&()*+,./:;?@\\^_`{|}~-]+$")

_TAILS = rb"!#$%&()*+,./:;?@\^_`{|}~-"
_TAIL_BYTES = frozenset(_TAILS)

#: Runs that are one piece: letters of Latin-1 (without the three that are not letters of an alphabet), or ASCII punctuation but "'".
_PLAIN = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+|[!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~-]+")
#: Byte-level BPE writes bytes as letters: printable ones of Latin-1 as themselves, the others as U+0100 and on, in order.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_MOVED = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)} | {0x20: " "}
_LETTERS = "".join(_MOVED.get(b, chr(b)) for b in range(256))


class Encoder:
    """Ids of a tokenizers file without special tokens, as little-endian uint32 bytes.

    For tokenizers that split at white space and drop it, the ids of a text are those of its words in order; words
    are encoded by the library once and remembered. `by_word` is checked against the file's own
    description, and other tokenizers get whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = splits_at_space(spec)
        self.memo: dict[bytes, bytes] = {}
        if self.by_word:
            # The file's BPE model alone, for words that its other steps leave in one piece; many words go as one text.
            self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letter_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of ASCII letters, which the model has as themselves."""
        out = self.cut_ids(b" ".join(words).lower().decode("ascii"), len(words))
        return self.ids([w.decode("ascii") for w in words]) if out is None else out

    def plain_ids(self, words: list[str]) -> list[bytes]:
        """The ids of words that match _PLAIN: lower-cased, their bytes as the model's letters."""
        out = self.cut_ids(codecs.charmap_decode(" ".join(words).lower().encode(), "strict", _LETTERS)[0], len(words))
        return self.ids(words) if out is None else out

    def cut_ids(self, text: str, n: int) -> list[bytes] | None:
        """The ids of a text's n words, cut where a word's last id stands; None for a model whose words do not end as described."""
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.r_[0, np.flatnonzero(self.ends[ids]) + 1]
        if len(cuts) != n + 1:
            return None
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_word:
            return self.ids([t.decode("utf-8", "replace") for t in texts])
        words = [t.translate(_LOWER if lowers_alike(t) else _SPACE).split(b" ") for t in texts]
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        memo[b""] = b""
        fresh = set(itertools.chain.from_iterable(words)).difference(memo)
        letters = set(filter(bytes.isalpha, fresh))  # of ASCII: nothing else is to be asked of them
        plain: dict[bytes, str] = {}
        other: dict[bytes, str] = {}
        cut: dict[bytes, list[bytes]] = {}
        for w in fresh - letters:
            own = [w]
            if w[-1] in _TAIL_BYTES:
                head = w.rstrip(_TAILS)
                if len(xs := [head, w[len(head) :]] if head.isalpha() else pieces(w)) > 1:
                    own = cut[w] = xs
            for x in own:
                if x in memo:
                    continue
                if x.isalpha():
                    letters.add(x)
                else:
                    t = x.decode("utf-8", "replace")
                    (plain if _PLAIN.fullmatch(t) else other)[x] = t
        easy = list(letters)
        for keys, asked, encode in ((easy, easy, self.letter_ids), (list(plain), list(plain.values()), self.plain_ids), (list(other), list(other.values()), self.ids)):
            for a in range(0, len(keys), ASKED_WORDS):
                memo.update(zip(keys[a : a + ASKED_WORDS], encode(asked[a : a + ASKED_WORDS]), strict=True))
        for w, (head, tail) in cut.items():
            memo[w] = memo[head] + memo[tail]
        return [b"".join(map(memo.__getitem__, ws)) for ws in words]


def lowers_alike(text: bytes) -> bool:
    """Whether lower-casing A-Z first changes nothing: no added token can arise, and no combining mark (U+0300-036F) follows a letter."""
    return b"<|" not in text and (text.isascii() or (b"\xcc" not in text and b"\xcd" not in text))


def pieces(word: bytes) -> list[bytes]:
    """A word without its punctuation at the end, and that; they are split there anyway."""
    if word[-1] < 0x80 and (tail := _TAIL.search(word)) and tail.start() and b"<|" not in word and word[: tail.start()].decode("utf-8", "replace")[-1].lower()[-1].isalnum():
        return [word[: tail.start()], tail[0]]
    return [word]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """A worker's encoder, which outlasts its tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def splits_at_space(spec: dict) -> bool:
    """Whether a text's ids are those of its space-separated words: nothing in the file's steps looks across a space or keeps one."""

    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    normal = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps(spec["normalizer"], "normalizers"))
    split, *rest = steps(spec["pre_tokenizer"], "pretokenizers") or [{"type": ""}]
    no_space = split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and split["pattern"].get("Regex", "") == "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    plain = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in rest)
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    ends = spec["model"].get("type", "BPE") == "BPE" and bool(spec["model"].get("end_of_word_suffix")) and not spec["model"].get("dropout")
    return normal and no_space and plain and added and ends and spec["post_processor"] is None and spec["truncation"] is None and spec["padding"] is None


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of parts of a batch of about BLOCK_BYTES; null: empty. Only such a part is held as Python's texts."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()
    held, size, first = [], 0, 0
    for start in range(0, batch.num_rows, 64):
        for i, text in enumerate(batch.column(column).slice(start, 64).cast(kind).to_pylist(), start):
            held.append(text or b"")
            size += len(text or b"")
            if size >= BLOCK_BYTES:
                yield first, held
                held, size, first = [], 0, i + 1
    if held:
        yield first, held


def encoded_lengths(documents: DataFrame, tokenizer: str, *, end_id: bool = True) -> DataFrame:
    """doc_id and n_tokens (with an end id, unless told otherwise) of each row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for first, texts in _blocks(batch, "text"):
                n = [len(x) // 4 + end_id for x in encoder.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(n)), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def write_tokens(documents: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, files: int | None = None, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10) -> None:
    """Encodes every row's text, appends end_id, and writes the token files.

    Order: doc_id ascending (null first), rows of equal doc_id by a hash of their text. Files are as many as Spark's shuffle
    partitions, or more, so that one has about FILE_ROWS rows. Null and empty texts
    have the end id alone. Columns beside doc_id and text are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        file_no, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in _blocks(batch, "text"):
                ids = [x + end for x in encoder.encode(texts)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.r_[0, np.cumsum(n)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").view(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(ids)), lists, pa.array(n), pa.array(np.full(len(ids), file_no, np.int32)), pa.array(at + offsets[:-1])], names)
                at += int(offsets[-1])

    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("file_no", T.IntegerType()), T.StructField("local_start", T.LongType())])
    names = schema.fieldNames()
    files = files or max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // FILE_ROWS))
    ordered = documents.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    options = {
        "compression": "zstd",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.writer.version": "v2",  # delta encodings where a dictionary does not pay
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.page.write-checksum.enabled": "true",
    }
    ordered.select("doc_id", "text").mapInArrow(run, schema).write.options(**options).parquet(path)


def read_tokens(tokens: DataFrame) -> DataFrame:
    """The token files with `start`; reads file_no, local_start and n_tokens alone for it, one row of sums a file."""
    from pyspark.sql import Window

    sums = tokens.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("file_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return tokens.join(F.broadcast(starts), "file_no").withColumn("start", F.col("before") + F.col("local_start")).drop("before", "local_start")


def ids_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: the unsigned CRC-32 of all ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes()
            at = lists.offsets.to_numpy().tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
