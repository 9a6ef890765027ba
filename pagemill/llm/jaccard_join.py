"""N-gram Jaccard join by a token-group matrix.

Documents become sets of word shingles. Similar documents are put into groups (by a popular one of a
few min-hashes), every group has the union of its tokens, and a document is compared with the members of a
group only if its overlap with that union reaches what a member would need. Which groups a document is
held against at all comes from the matrix of necessary prefix tokens and groups, and from the sizes of sets. The join is
exact: a group is only a way of packing, and a pair at or above the threshold always shares 1 + MORE tokens of
prefixes that are longer by MORE.

Scale. The texts are read three times (counts, postings, sets of candidate groups); nothing but fixed-size
count sketches is broadcast. Copies collapse into one class by the digest of their sets, copies and near
copies within a task give one posting for each token and group, and popular groups are split by a count.
Sets of candidate groups are the only ones that move. Links are a spanning forest, not all pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import ASCII_LOWER, Forest, Scratch, WordHashes, components, mixed, runs, texts

#: Buckets of the two count sketches (tokens, min-hashes); 4 bytes each, whatever the input.
SKETCH_BITS = 20
#: Documents that a group holds, and tokens of them, about: a group of long texts has fewer of them.
GROUP_ROWS, GROUP_TOKENS = 1_024, 1 << 22
#: Shingles of the corpus for each task that pairs groups; a seventh or so of them are prefix tokens.
SHINGLES_A_TASK = 16_000_000
#: Prefix tokens beyond the first that two similar documents must share; prefixes are longer by as many.
MORE = 5
#: Min-hashes from which a document's group is chosen: by the one that is third in popularity, which unrelated
#: documents with a passage in common seldom share, and members of a large group of near copies nearly always do.
MIN_HASHES, CHOSEN = 8, 3
_MULTIPLIERS = (np.arange(1, MIN_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TOP = np.uint64(64 - SKETCH_BITS)
_LOW = (np.uint64(1) << _TOP) - np.uint64(1)
_MOST = np.uint64((1 << SKETCH_BITS) - 1)
_CHUNK = 1 << 14


def shingles(text: bytes | None, size: int, words_of: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; one of the whole sequence if it has fewer words."""
    words = text.translate(ASCII_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    k = min(size, len(words))
    hashes = words_of.of(words)
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mixed(out + hashes[i : i + n])
    return np.unique(out)


def min_hashes(tokens: np.ndarray) -> np.ndarray:
    return mixed(np.array([(tokens * m).min() for m in _MULTIPLIERS], np.uint64))


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any set at or above the threshold."""
    return -(-percent * n // 100)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def _sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Counts of this task's tokens and min-hashes by bucket, as rows (part, counts)."""
    words = WordHashes()
    counts = np.zeros((2, 1 << SKETCH_BITS), np.uint32)
    for batch in batches:
        sets = [shingles(t, size, words) for t in texts(batch.column("text"))]
        sets = [s for s in sets if len(s)]
        if sets:
            for k, found in enumerate((np.concatenate(sets), np.concatenate([min_hashes(s) for s in sets]))):
                counts[k] += np.bincount((found >> _TOP).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
    flat = counts.reshape(-1)
    for a in range(0, len(flat), _CHUNK):
        part = flat[a : a + _CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([a // _CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the counts of the parts that this task has; each has at most all parts."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.uint32).astype(np.uint64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in sums.values()], pa.binary())], ["part", "counts"])


def count_sketches(documents: DataFrame, size: int) -> np.ndarray:
    """Two rows of 2^SKETCH_BITS counts over all documents; 8 MB in all, whatever the input."""
    schema = "part int, counts binary"
    parts = 2 * (1 << SKETCH_BITS) // _CHUNK
    rows = documents.select("text").mapInArrow(lambda b: _sketches(b, size), schema).repartition(parts // 4, "part").mapInArrow(_added, schema).toArrow()
    out = np.zeros(2 << SKETCH_BITS, np.uint32)
    for part, counts in zip(rows.column("part").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        out[part * _CHUNK : (part + 1) * _CHUNK] = np.frombuffer(counts, np.uint32)
    return out.reshape(2, -1)


def group_parts(popular: int, n: int, group_rows: int) -> int:
    """Into how many groups the documents of a min-hash are dealt, by how many there are and by their size (a power of two, so that near copies agree)."""
    return popular // max(1, min(group_rows, GROUP_TOKENS >> (n - 1).bit_length())) + 1


def _grouped(batches: Iterator[pa.RecordBatch], sketches: Callable[[], np.ndarray], size: int, percent: int, group_rows: int) -> Iterator[pa.RecordBatch]:
    """For each document (doc_id, n, s1, s2, grp); for each of its prefix tokens and its group a posting (grp, token)."""
    words, seen = WordHashes(), set()
    by_token, by_key = sketches()
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        rows: list[tuple] = []
        postings: list[np.ndarray] = []
        groups: list[int] = []
        for doc, text in zip(ids, texts(batch.column("text")), strict=True):
            tokens = shingles(text, size, words)
            n = len(tokens)
            if not n:
                rows.append((doc, 0, None, None, None))
                continue
            digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
            s1, s2 = (x - (1 << 63) for x in (digest >> 64, digest & (1 << 64) - 1))
            keys = min_hashes(tokens)
            popular = by_key[(keys >> _TOP).astype(np.int64)]
            best = int(np.argsort(popular, kind="stable")[-CHOSEN])
            grp = int(mixed(keys[best : best + 1] + np.uint64(digest % group_parts(int(popular[best]), n, group_rows)))[0]) - (1 << 63)
            rows.append((doc, n, s1, s2, grp))
            # A set so small that every other set falls below the threshold has copies only.
            if digest in seen or needed(n + 1, percent) > n and needed(n, percent) == n:
                continue
            seen.add(digest)
            rank = np.minimum(by_token[(tokens >> _TOP).astype(np.int64)].astype(np.uint64), _MOST) << _TOP | (tokens & _LOW)
            prefix = tokens[np.argsort(rank, kind="stable")[: n - needed(n, percent) + 1 + MORE]]
            if n <= 2 * (MORE + 1):  # it may share fewer: each token counts in full, against sets as small
                prefix = np.concatenate([prefix, *(mixed(prefix + np.uint64(i)) for i in range(1, MORE + 1))])
            postings.append(prefix)
            groups.extend([grp] * len(prefix))
        doc, n, s1, s2, grp = zip(*rows, strict=True) if rows else [()] * 5
        blank = pa.nulls(len(rows), pa.int64())
        yield _batch(pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(grp, pa.int64()), blank)
        if postings:
            token, owner = distinct_pairs(np.concatenate(postings).view(np.int64), np.array(groups, np.int64))
            none = pa.nulls(len(token), pa.int64())
            yield _batch(none, none, none, none, pa.array(owner), pa.array(token))


_GROUPED = "doc_id long, n long, s1 long, s2 long, grp long, token long"


def _batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), [x.split()[0] for x in _GROUPED.split(", ")])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of groups that share a token, from all postings of this task's tokens."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    token = np.concatenate([b.column("token").to_numpy() for b in got])
    grp = np.concatenate([b.column("grp").to_numpy() for b in got])
    token, grp = distinct_pairs(token, grp)
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    ends = np.r_[starts[1:], len(token)]
    wide = ends - starts > 1
    held, size = [], 0  # pairs with a count each, and how many pairs
    for a, b in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
        for i in range(a, b - 1):  # a row at a time: one token's pairs need not fit in memory
            held.append((np.full(b - i - 1, grp[i]), grp[i + 1 : b]))
            size += b - i - 1
        if size > 1 << 18:
            yield _pairs(held)
            held, size = [], 0
    if held:
        yield _pairs(held)


def _pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    g, h = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((h, g))
    g, h = g[order], h[order]
    starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(g[starts]), pa.array(h[starts]), pa.array(np.diff(np.r_[starts, len(g)]))], ["g", "h", "shared"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    words, seen = WordHashes(), set()
    for batch in batches:
        rows = []
        for grp, crossed, doc, text in zip(*(batch.column(c).to_pylist() for c in ("grp", "crossed", "doc_id")), texts(batch.column("text")), strict=True):
            tokens = shingles(text, size, words).tobytes()
            if tokens and (key := (grp, doc, xxhash.xxh3_64_intdigest(tokens))) not in seen:  # repeated rows come to one task, by doc_id
                seen.add(key)
                rows.append((grp, crossed, doc, tokens))
        if rows:
            grp, crossed, doc, tokens = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(crossed, pa.bool_()), pa.array(doc, pa.int64()), pa.array(tokens, pa.binary())], ["grp", "crossed", "doc_id", "tokens"])


_MATRIX = "grp long, docs array<long>, sizes array<int>, union binary, places binary, a array<long>, b array<long>"


def _matrix(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """One row a group: its members, the union of their tokens, each member's tokens as places in the union (steps, packed), and the links within.

    Groups that are held against no other one leave out all but the links.
    """
    for rows in runs(batches, ["grp"]):
        docs = rows.column("doc_id").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
        order = np.lexsort(([len(x) for x in sets], docs)).tolist()
        sets = [sets[i] for i in order]
        union, places = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(x) for x in sets], np.int32)
        steps = np.diff(places, prepend=0).astype(np.int32)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        steps[starts] = places[starts]
        group = TokenGroup(docs[order], sizes, union.tobytes(), steps.tobytes())
        links = _between(group, group, percent)
        kept = [docs[order], sizes, union.tobytes(), zlib.compress(steps.tobytes(), 1)] if rows.column("crossed")[0].as_py() else [None] * 4
        values = [rows.column("grp")[0].as_py(), *kept, [x for x, _ in links], [y for _, y in links]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in _MATRIX.split(", ")])


class TokenGroup:
    """One group's column of the matrix: the union of its tokens, and behind it which members have them."""

    def __init__(self, docs: list[int], sizes: list[int], union: bytes, steps: bytes) -> None:
        self.docs = np.array(docs, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.union = np.frombuffer(union, np.uint64)
        steps = np.frombuffer(steps, np.int32).astype(np.int64)
        self.cuts = np.r_[0, np.cumsum(self.sizes)]
        sums = np.cumsum(steps)
        self.places = sums - np.repeat(np.r_[0, sums[self.cuts[1:-1] - 1]], self.sizes)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.owner = owner[np.argsort(self.places, kind="stable")]
        self.first = np.r_[0, np.cumsum(np.bincount(self.places, minlength=len(self.union)))]

    def member(self, i: int) -> np.ndarray:
        return self.union[self.places[self.cuts[i] : self.cuts[i + 1]]]

    def open(self, query: np.ndarray, least: int, percent: int) -> np.ndarray:
        """The members that a query links with; none without a look at them if the union holds too few of its tokens."""
        at = np.searchsorted(self.union, query)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == query]
        if len(at) < least:
            return np.empty(0, np.int64)
        a, length = self.first[at], self.first[at + 1] - self.first[at]
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        both = np.bincount(self.owner[np.repeat(a, length) + inside], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (len(query) + self.sizes - both))


def _between(group: TokenGroup, queries: TokenGroup, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between a group and the members of another, or of itself."""
    base = 0 if queries is group else len(group.docs)
    forest, found = Forest(base + len(queries.docs)), []
    for q in range(len(queries.docs)):
        if forest.sets == 1:
            break
        tokens = queries.member(q)
        for member in group.open(tokens, needed(len(tokens), percent), percent).tolist():
            if forest.join(base + q, member):
                found.append((int(queries.docs[q]), int(group.docs[member])))
    return found


def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for rows in runs(batches, ["g", "h"]):
        group, queries = (TokenGroup(r["docs"], r["sizes"], r["union"], zlib.decompress(r["places"])) for r in sorted(rows.to_pylist(), key=lambda r: r["side"]))
        if found := _between(group, queries, percent):
            x, y = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def _verified(pairs: DataFrame, matrix: DataFrame, percent: int, tasks: int) -> DataFrame:
    """The links of pairs (g, h) of different groups. A pair is two rows of the matrix."""
    sides = pairs.select("g", "h", F.col("g").alias("grp"), F.lit(0).alias("side")).unionByName(pairs.select("g", "h", F.col("h").alias("grp"), F.lit(1).alias("side")))
    rows = sides.join(matrix.select("grp", "docs", "sizes", "union", "places"), "grp")
    return rows.repartition(tasks, "g", "h").sortWithinPartitions("g", "h").drop("grp").mapInArrow(lambda b: _links(b, percent), "a long, b long")


def jaccard_components(documents: DataFrame, *, size: int = 5, percent: int = 80, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of `documents` (doc_id, text), linked at Jaccard >= percent / 100.

    Words are runs of bytes other than ASCII white space after lower-casing A-Z; shingles are `size` words,
    or the whole sequence if a text has fewer. component_id is the smallest doc_id reachable by links.
    Null, empty and blank texts have no shingles and link with nothing. Rows with equal doc_id are one
    document for the links and keep a row each; a null doc_id has its n_shingles, but neither links nor
    a component. Shingles are compared as 64-bit hashes. Columns beside doc_id and text are not read.
    """
    if not 50 < percent <= 100 or size < 1:
        raise ValueError("percent is over 50 and at most 100, size at least 1")
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    sketches = count_sketches(documents, size)
    sent = spark.sparkContext.broadcast(sketches)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sketches[0].sum(dtype=np.uint64)) // SHINGLES_A_TASK)
    both = scratch.put(documents.select("doc_id", "text").mapInArrow(lambda b: _grouped(b, lambda: sent.value, size, percent, group_rows), _GROUPED), "grouped")
    sent.destroy()
    rows = both.where("token is null").drop("token")
    classes = scratch.put(rows.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("grp").alias("grp"), F.max("n").alias("n")), "classes")
    shared = both.where("token is not null").select("grp", "token").repartition(tasks, "token").mapInArrow(_shared, "g long, h long, shared long")
    shared = shared.groupBy("g", "h").agg(F.sum("shared").alias("shared")).where(F.col("shared") > MORE).select("g", "h")
    spans = classes.groupBy("grp").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    for side in ("g", "h"):
        shared = shared.join(spans.select(F.col("grp").alias(side), F.col("least").alias(f"least_{side}"), F.col("most").alias(f"most_{side}")), side)
    fits = f"100 * most_g >= {percent} * least_h and 100 * most_h >= {percent} * least_g"
    candidates = scratch.put(shared.where(fits).select("g", "h"), "candidates")
    hub = candidates.groupBy(F.col("h").alias("x")).agg(F.min("g").alias("g"))
    crossed = candidates.select(F.col("g").alias("grp")).union(candidates.select("h")).distinct().withColumn("crossed", F.lit(True))
    within = classes.groupBy("grp").count().where("count > 1").select("grp")
    open_groups = crossed.join(within, "grp", "full_outer").select("grp", F.coalesce("crossed", F.lit(False)).alias("crossed"))
    wanted = classes.join(open_groups, "grp").select(F.col("rep").alias("doc_id"), "grp", "crossed").distinct()
    read = documents.where("doc_id is not null").select("doc_id", "text").join(wanted, "doc_id").select("grp", "crossed", "doc_id", "text")
    sets = read.mapInArrow(lambda b: _sets(b, size), "grp long, crossed boolean, doc_id long, tokens binary")
    matrix = scratch.put(sets.repartition(tasks, "grp").sortWithinPartitions("grp").mapInArrow(lambda b: _matrix(b, percent), _MATRIX), "matrix")

    # The links within groups are there; each group with one neighbour joins the parts of a large group of near copies.
    first = hub.select("g", F.col("x").alias("h"))
    inner = matrix.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b")
    near = scratch.put(inner.unionByName(_verified(first, matrix, percent, tasks)), "near")
    known = scratch.put(components(scratch, near, "near-parts"), "known") if near.take(1) else near.selectExpr("a as node", "b as component")
    # Then all other pairs but those whose documents are known to be of one component.
    inside = classes.join(known, classes["rep"] == known["node"], "left").groupBy("grp").agg(F.min(F.coalesce("component", "rep")).alias("low"), F.max(F.coalesce("component", "rep")).alias("high"))
    rest = candidates.join(first, ["g", "h"], "left_anti")
    for side in ("g", "h"):
        rest = rest.join(inside.select(F.col("grp").alias(side), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}")), side)
    rest = rest.where("not (low_g = high_g and low_h = high_h and low_g = low_h)").select("g", "h")
    far = _verified(rest, matrix, percent, tasks)
    links = scratch.put(near.unionByName(far), "links")
    scratch.drop("matrix", "candidates", "near")
    parts = scratch.put(components(scratch, links), "parts")
    named = classes.join(parts, classes["rep"] == parts["node"], "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = rows.where("n > 0 and doc_id is not null").join(named, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    rest_rows = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest_rows)


def one_per_component(documents: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose doc_id is the smallest of their component. Rows without a doc_id stay.

    Of rows with equal doc_id and equal text one stays, the first in order of its other columns. Where texts differ
    under one doc_id, each is a document of its own: those that are near copies of nothing stay, all of them.
    """
    columns = documents.columns
    named = documents.where("doc_id is not null").withColumn("_key", F.col("doc_id"))
    texts_of = named.select("doc_id", F.sha2(F.col("text"), 256).alias("digest")).distinct().groupBy("doc_id").count()
    several = texts_of.where("count > 1").select("doc_id")
    if several.take(1):
        # a negative hash of doc_id and text stands for the doc_id
        own = F.xxhash64("doc_id", F.coalesce(F.sha2(F.col("text"), 256), F.lit(""))).bitwiseOR(F.lit(-(2**63)))
        named = named.join(several.withColumn("_several", F.lit(True)), "doc_id", "left").withColumn("_key", F.when(F.col("_several"), own).otherwise(F.col("_key")))
        parts = jaccard_components(named.select(F.col("_key").alias("doc_id"), "text"), size=size, percent=percent).select(F.col("doc_id").alias("_key"), "component_id")
        first = parts.join(named.select("_key", "doc_id").distinct(), "_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first"))
        kept = first.select("first._key")
    else:
        kept = jaccard_components(documents, size=size, percent=percent).where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    ordered = [c for c in columns if not any(x in documents.schema[c].dataType.simpleString() for x in ("map<", "variant"))]
    row = F.min(F.struct(*columns)) if ordered == columns else F.min_by(F.struct(*columns), F.struct(*ordered))
    named = named.join(kept, "_key", "left_semi").groupBy("_key").agg(row.alias("row")).select("row.*")
    return named.unionByName(documents.where("doc_id is null").select(columns))
