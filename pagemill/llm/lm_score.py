"""LM scoring: cross-entropy difference of a target and a background model.

Two word bigram models of the same form, one of target texts and one of background texts, share one vocabulary. A
document's score is the mean over its words of the target model's loss less the background's: low scores are
like the target.

The models. The vocabulary is every word of either table; words of neither are one unknown word. Bigrams are
counted exactly, all of them, and interpolate with the unigrams: P(w | h) = L c(h, w) / c(h) + (1 - L) P(w), or P(w) where
h has no successor. So both are distributions over the same vocabulary, and they grow with the corpus. They are matched: P(w) is
smoothed in proportion to a model's words (one count a word for the smaller model), so that unseen words
have the same share in both, however much longer the background is. A row that is counted as well as scored is scored
without its own counts.

Scale: texts are cut into chunks of tasks, each staged once as word numbers. A chunk sends each of its distinct words and
bigrams once, with its counts in target and background side by side, as packed rows for ranges of their hashes; so a hot
word is one entry a chunk. Ranges are as many as the corpus has words for, so that one holds the same at every size. A range adds up what all chunks sent and answers each chunk with the sums of what it
asked for, in its order. Nothing is broadcast or collected but totals. Words and bigrams are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Scratch, mixed, runs, texts
from .decontaminate import words_of

#: Weight of the bigram where its first word has counts.
BIGRAM_WEIGHT = 0.7
#: Words after which a task begins a new chunk.
CHUNK_WORDS = 3_000_000
#: Words of the corpus for each range of hashes, about; a range holds what all chunks send for it.
RANGE_WORDS = 1_000_000
#: Distinct words that a task adds up before it sends their counts.
_HELD = 500_000
#: What a row of `role` is for; roles add up.
SCORED, TARGET, BACKGROUND = 1, 2, 4

_KEYS = "chunk long, part int, asks boolean, keys binary, counts binary"
_SUMS = "chunk long, part int, sums binary, words long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def sent() -> pa.RecordBatch:
        words = [w.decode("utf-8", "replace") for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in texts(batch.column("text")):
            counts.update(words_of(text))
        if len(counts) > _HELD:
            yield sent()
            counts.clear()
    if counts:
        yield sent()


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all texts; tasks add up before they send."""
    return documents.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _packed(values: np.ndarray) -> bytes:
    """An array of whole numbers from 0 by planes of bytes, as many as the largest needs, compressed."""
    values = values.ravel()
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = np.empty((width, len(values)), np.uint8)
    for k in range(width):
        planes[k] = values >> values.dtype.type(8 * k) & values.dtype.type(255)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(raw: bytes, kind: type = np.uint64) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros(n, kind)
    for k in range(width):
        out |= planes[k].astype(kind) << kind(8 * k)
    return out


def _staged(batches: Iterator[pa.RecordBatch], capped: tuple[set[bytes], set[bytes]] | None, kind: pa.DataType, chunk_words: int) -> Iterator[pa.RecordBatch]:
    """A row a chunk: its documents, the hashes of its distinct words, and its texts as numbers of these words.

    capped: the vocabulary and those of its words between which bigrams count; words outside are the empty word.
    """
    first = TaskContext.get().partitionId() << 32
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    held: list[np.ndarray] = []
    docs: list[pa.Array] = []
    roles: list[int] = []
    seen = words = 0

    def row() -> pa.RecordBatch:
        known = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
        core = np.fromiter((capped is None or w in capped[1] for w in ids), np.uint64, len(ids))
        flat = np.concatenate(held)
        lengths = np.array([len(x) for x in held], np.uint64)
        of = {r: sum(len(x) for x, own in zip(held, roles, strict=True) if own & r) for r in (TARGET, BACKGROUND)}
        doc_ids = pa.concat_arrays(docs)
        columns = {
            "chunk": pa.array([first + seen], pa.int64()),
            "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
            "asks": pa.array([any(r & SCORED for r in roles)]),
            "n_target": pa.array([of[TARGET]], pa.int64()),
            "n_background": pa.array([of[BACKGROUND]], pa.int64()),
            "n_words": pa.array([len(flat)], pa.int64()),
        } | {k: pa.array([_packed(v)], pa.binary()) for k, v in (("known", known), ("core", core), ("flat", flat), ("lengths", lengths), ("roles", np.array(roles, np.uint64)))}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    for batch in batches:
        names = batch.column("doc_id").cast(kind)
        roles_in = batch.column("role").to_pylist()
        start = 0
        for k, text in enumerate(texts(batch.column("text"))):
            own = words_of(text)
            if capped is not None:
                own = [w if w in capped[0] else b"" for w in own]
            held.append(np.fromiter(map(ids.__getitem__, own), np.int32, len(own)))
            roles.append(roles_in[k])
            words += len(own)
            if words >= chunk_words:
                docs.append(names[start : k + 1])
                yield row()
                start, words, seen = k + 1, 0, seen + 1
                ids.clear()
                held, docs, roles = [], [], []
        docs.append(names[start:])
    if held:
        yield row()


class Chunk:
    """A staged chunk: its words in order of hash, and its bigrams in order of theirs."""

    def __init__(self, row: dict) -> None:
        known, core = _unpacked(row["known"]), _unpacked(row["core"], np.uint8).astype(bool)
        self.lengths, self.roles = _unpacked(row["lengths"], np.int64), _unpacked(row["roles"], np.uint8)
        order = np.argsort(known)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.known, core = known[order], core[order]
        self.flat = place[_unpacked(row["flat"], np.int32)]
        self.starts = np.zeros(len(self.flat), bool)
        self.starts[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = True
        second = ~self.starts
        second[1:] &= core[self.flat[:-1]] & core[self.flat[1:]]
        self.second = np.flatnonzero(second).astype(np.int32)  # where a bigram ends that counts
        pairs, of = np.unique(self.flat[self.second - 1].astype(np.int64) << 32 | self.flat[self.second], return_inverse=True)
        head, tail = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        keys = mixed(mixed(self.known[head] + np.uint64(1)) + self.known[tail])
        order = np.argsort(keys)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pairs, self.head, self.tail, self.pair = keys[order], head[order], tail[order], place[of]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: as a word and as a bigram's first, in target and in background; of each bigram: in target and in background."""
        words, pairs = [], []
        roles = np.repeat(self.roles, self.lengths)
        for role in (TARGET, BACKGROUND):
            inside = roles & np.uint8(role) > 0
            ends = inside[self.second]
            words += [np.bincount(self.flat[inside], minlength=len(self.known)), np.bincount(self.flat[self.second[ends] - 1], minlength=len(self.known))]
            pairs.append(np.bincount(self.pair[ends], minlength=len(self.pairs)))
        return np.stack(words), np.stack(pairs)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of so many even ranges of hashes begins and ends among sorted keys."""
    edges = np.array([(k << 64) // parts for k in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _sent(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk a row for each range of words (even part) and of bigrams (odd part)."""
    for batch in batches:
        for row in batch.to_pylist():
            chunk = Chunk(row)
            for odd, keys, counts in zip((0, 1), (chunk.known, chunk.pairs), chunk.counts(), strict=True):
                cuts = _cuts(keys, parts)
                full = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
                own = [slice(cuts[k], cuts[k + 1]) for k in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["chunk"]] * len(full), pa.int64()),
                        pa.array([2 * k + odd for k in full], pa.int32()),
                        pa.array([row["asks"]] * len(full), pa.bool_()),
                        pa.array([_packed(np.diff(keys[s], prepend=np.uint64(0))) for s in own], pa.binary()),
                        pa.array([_packed(counts[:, s]) for s in own], pa.binary()),
                    ],
                    ["chunk", "part", "asks", "keys", "counts"],
                )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums over all chunks of what each chunk that asks has sent, and on one row the words that the range has."""
    for table in runs(batches, ["part"]):
        part = table["part"][0].as_py()
        width = 2 if part % 2 else 4
        sent = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in table["keys"].to_pylist()]
        counts = np.concatenate([_unpacked(x).reshape(width, -1) for x in table["counts"].to_pylist()], axis=1)
        keys = np.concatenate(sent)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, sums = keys[begins], np.add.reduceat(counts[:, order], begins, axis=1)
        words = 0 if part % 2 else int((sums[0] + sums[2] > 0).sum())
        for chunk, asks, own in zip(table["chunk"].to_pylist(), table["asks"].to_pylist(), sent, strict=True):
            if asks or words:
                answer = _packed(sums[:, np.searchsorted(keys, own)]) if asks else None
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([answer], pa.binary()), pa.array([words], pa.int64())], ["chunk", "part", "sums", "words"])
                words = 0


def _often(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key among the distinct ones, and how often it occurs."""
    place = np.unique(keys, return_inverse=True)[1]
    return place, np.bincount(place)[place]


def _means(chunk: Chunk, words: np.ndarray, pairs: np.ndarray, totals: tuple[int, int], vocabulary: int, together: int) -> np.ndarray:
    """The mean loss in nats of each document's words, by the target model and by the background's; 0 without words. About `together` words at a time."""
    lengths = chunk.lengths
    ends = np.cumsum(lengths)
    out = np.zeros((2, len(lengths)))
    smooth = [t / min(totals) if min(totals) else 1.0 for t in totals]
    a = 0
    while a < len(lengths):
        begin = int(ends[a] - lengths[a])
        b = max(a + 1, int(np.searchsorted(ends, begin + together, side="right")))
        end, n = int(ends[b - 1]), lengths[a:b]
        flat, doc = chunk.flat[begin:end], np.repeat(np.arange(b - a), n)
        bounds = np.searchsorted(chunk.second, [begin, end])
        second, pair = chunk.second[slice(*bounds)] - begin, chunk.pair[slice(*bounds)]
        alone = ~chunk.starts[begin:end]
        alone[second] = False
        alone = np.flatnonzero(alone)  # where a bigram ends that doesn't count
        place, own_word = _often(doc << 32 | flat)
        own_after = np.bincount(place[second - 1], minlength=len(flat))[place]
        own_pair = _often(doc[second] << 32 | pair)[1]
        for k, role in enumerate((TARGET, BACKGROUND)):
            counted = chunk.roles[a:b] & np.uint8(role) > 0
            own = counted[doc]
            p = (words[2 * k][flat] - own * own_word + smooth[k]) / (totals[k] - (counted * n)[doc] + smooth[k] * (vocabulary + 1.0))
            after = words[2 * k + 1][flat] - own * own_after  # of each word as a bigram's first
            loss = -np.log(p)
            loss[alone] -= np.where(after[alone - 1] > 0, np.log(1 - BIGRAM_WEIGHT), 0.0)
            weight = np.where(after[second - 1] > 0, BIGRAM_WEIGHT, 0.0)
            loss[second] = -np.log(weight / np.maximum(after[second - 1], 1) * (pairs[k][pair] - own[second] * own_pair) + (1 - weight) * p[second])
            out[k, a:b] = np.bincount(doc, loss, minlength=b - a) / np.maximum(n, 1)
        a = b
    return out


def _scores(batches: Iterator[pa.RecordBatch], totals: tuple[int, int], vocabulary: int, kind: pa.DataType, together: int) -> Iterator[pa.RecordBatch]:
    """Chunks and the answers to them, sorted by chunk and part; a chunk itself has part -1."""
    for table in runs(batches, ["chunk"]):
        row = table.slice(0, 1).to_pylist()[0]
        chunk = Chunk(row)
        answers: tuple[list, list] = ([], [])
        for part, raw in zip(table["part"].to_pylist()[1:], table["sums"].to_pylist()[1:], strict=True):
            answers[part % 2].append(_unpacked(raw).reshape(2 if part % 2 else 4, -1))
        words, pairs = (np.concatenate(x, axis=1) if x else np.zeros((w, 0)) for x, w in zip(answers, (4, 2), strict=True))
        n = chunk.lengths
        full = n > 0
        means = _means(chunk, words.astype(np.float64), pairs.astype(np.float64), totals, vocabulary, together)
        doc_ids = table.column("doc_ids").slice(0, 1).combine_chunks().flatten().cast(kind)
        out = [doc_ids, pa.array(n), *(pa.array(x, mask=~full) for x in (*means, means[0] - means[1]))]
        asked = pa.array(chunk.roles & np.uint8(SCORED) > 0)
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"]).filter(asked)


def difference_by_role(rows: DataFrame, *, capped: tuple[set[bytes], set[bytes]] | None = None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """`cross_entropy_difference` of rows (doc_id, text, role): a row's role is the sum of SCORED, TARGET and BACKGROUND as they hold for it.

    A row that is TARGET or BACKGROUND as well as SCORED is scored by models that have not counted it.
    """
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark, "lm-score")
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrow = spark.createDataFrame([], rows.select("doc_id").schema).toArrow().schema.field("doc_id").type
    sent = spark.sparkContext.broadcast(capped)
    schema = f"chunk long, doc_ids array<{kind}>, asks boolean, n_target long, n_background long, n_words long, known binary, core binary, flat binary, lengths binary, roles binary"
    chunks = scratch.put(rows.select("doc_id", "text", "role").mapInArrow(lambda b: _staged(b, sent.value, arrow, chunk_words), schema), "chunks")
    *totals, n_words, n_chunks = (n or 0 for n in chunks.agg(F.sum("n_target"), F.sum("n_background"), F.sum("n_words"), F.count("*")).first())
    totals = (totals[0], totals[1])
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2 * least, -(-n_words // RANGE_WORDS))
    keys = chunks.mapInArrow(lambda b: _sent(b, parts), _KEYS).repartition(-(-parts // 2), "part").sortWithinPartitions("part")
    sums = scratch.put(keys.mapInArrow(_summed, _SUMS), "sums")
    vocabulary = len(capped[0]) if capped is not None else sums.agg(F.sum("words")).first()[0] or 0
    asking = chunks.where("asks").drop("asks", "n_target", "n_background", "n_words").withColumn("part", F.lit(-1))
    both = asking.unionByName(sums.where("sums is not null").drop("words"), allowMissingColumns=True)
    both = both.repartition(max(least, n_chunks), "chunk").sortWithinPartitions("chunk", "part")
    return both.mapInArrow(lambda b: _scores(b, totals, vocabulary, arrow, max(1, chunk_words // 10)), f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, difference double")


def cross_entropy_difference(documents: DataFrame, target: DataFrame, background: DataFrame, *, vocabulary_size: int | None = None, core: int | None = None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference (nats a word) of `documents` (doc_id, text).

    `target` and `background` have a text column and are counted whole: all words, all bigrams. Words are runs of
    0-9, a-z and characters beyond ASCII after lower-casing A-Z. If `background` is `documents` itself, each row is
    left out of the background that scores it. A null, empty or wordless text has no tokens
    and null losses. Empty target or background tables give uniform models. Other columns are not read.

    Only where a caller asks for smaller models: `vocabulary_size` keeps that many words of the background, by count and
    then by word, and `core` counts bigrams between so many of these alone.
    """
    capped = None
    if vocabulary_size is not None or core is not None:
        top = word_counts(background).orderBy(F.desc("n"), "word")
        top = [w.encode() for w in (top if vocabulary_size is None else top.limit(vocabulary_size)).toArrow().column("word").to_pylist()]
        capped = (set(top), set(top if core is None else top[: max(1, core)]))
    kind = documents.schema["doc_id"].dataType
    same = background is documents
    rows = documents.select("doc_id", "text", F.lit(SCORED + BACKGROUND * same).alias("role"))
    for table, role in ((target, TARGET),) if same else ((target, TARGET), (background, BACKGROUND)):
        rows = rows.unionByName(table.select(F.lit(None).cast(kind).alias("doc_id"), "text", F.lit(role).alias("role")))
    return difference_by_role(rows, capped=capped, chunk_words=chunk_words)
