"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one kept per group.

Each vector has a home cell (its nearest centre). The way between two linked vectors of different cells crosses the plane
that parts these cells, so one of the two lies within half their distance of it. A vector is therefore shown to every
cell whose plane is at most half the threshold's distance away; that makes the comparison within cells
exact, whatever the centres are. A pair of which both see the other's cell counts in the cell of the smaller number.

Scale: equal vectors collapse into a class with a count. The centres are fitted on a bounded sample (`SAMPLE_BYTES`), on two
levels where there are many, and are all that is broadcast; every vector is assigned. Cells are cut into blocks of BLOCK_ROWS, so a hot
cell becomes many tasks of bounded size. No pairs are emitted: a block gives a count per vector and the edges
of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Scratch, components, runs

#: Vectors of a cell, about.
CELL_ROWS = 2_000
#: Bytes of vectors, as doubles, that the centres are fitted on at most, and how many of these a centre has.
SAMPLE_BYTES = 64 << 20
SAMPLE_A_CELL = 16
#: Similarities of vectors and centres that a worker holds at a time.
_HELD = 1 << 22
#: Vectors of a block; products are made in tiles of TILE rows.
BLOCK_ROWS = 4_096
TILE = 256
#: Blocks of a task, about.
BLOCKS_A_TASK = 4
#: Cosines this near the threshold are worked out again, one by one.
NEAR = 1e-9


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, k1, k2, vec): the digest and the doubles of each vector that can link, else nulls."""
    for batch in batches:
        column = batch.column("embedding")
        k1, k2, vecs = [], [], []
        for v in column.to_pylist():
            raw = None
            if v and None not in v:
                x = np.array(v, np.float64) + 0.0  # -0 becomes 0
                norm = np.linalg.norm(x / m) * m if np.isfinite(x).all() and (m := np.abs(x).max()) > 0 else 0.0
                if norm > 0:
                    raw = x.tobytes()
            digest = xxhash.xxh3_128_intdigest(raw) if raw else None
            k1.append(None if raw is None else (digest >> 64) - (1 << 63))
            k2.append(None if raw is None else (digest & (1 << 64) - 1) - (1 << 63))
            vecs.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "k1", "k2", "vec"])


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64) for r in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k unit centres of unit rows; an empty cell's centre moves to the row that fits worst."""
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        home, fit = s.argmax(axis=1), s.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(size < 1e-12)
        sums[lost] = x[np.argsort(fit)[: len(lost)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return np.unique(c, axis=0)


def fitted_centres(x: np.ndarray, k: int) -> np.ndarray:
    """About k centres of unit rows; many of them by parts, one for each of about the root of k first centres."""
    if k <= 256:
        return spherical_kmeans(x, k)
    first = spherical_kmeans(x, round(k**0.5))
    home = (x @ first.T).argmax(axis=1)
    parts = [x[home == j] for j in range(len(first)) if (home == j).any()]
    return np.unique(np.concatenate([spherical_kmeans(p, max(1, round(k * len(p) / len(x)))) for p in parts]), axis=0)


def _fit(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    raw = sorted(v for b in batches for v in b.column("vec").to_pylist())
    if raw:
        yield pa.RecordBatch.from_arrays([pa.array([fitted_centres(unit(raw), k).tobytes()], pa.binary())], ["centres"])


_CELLS = "dim int, cell int, home int, own int, shown array<int>, rep long, copies long, vec binary"


def _assigned(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray], reach: float) -> Iterator[pa.RecordBatch]:
    """A row of each class for its home cell (home = 1), with all cells it is shown to, and for each of these (home = 0, own: its home cell)."""
    names = [x.split()[0] for x in _CELLS.split(", ")]
    for batch in batches:
        raw = np.array(batch.column("vec").to_pylist(), object)
        dims = np.array([len(r) // 8 for r in raw.tolist()], np.int64)
        rep, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
        for d in np.unique(dims).tolist():
            at, c = np.flatnonzero(dims == d), centres[d]
            step = max(1, _HELD // len(c))
            for a in range(0, len(at), step):
                some = at[a : a + step]
                s = unit(raw[some].tolist()) @ c.T
                home = s.argmax(axis=1)
                homes, of = np.unique(home, return_inverse=True)
                apart = np.sqrt(np.maximum(2 - 2 * (c[homes] @ c.T), 0))
                shown = s.max(axis=1, keepdims=True) - s <= reach / 2 * apart[of] + 1e-9
                shown[np.arange(len(some)), home] = False
                i, cell = np.nonzero(shown)
                starts = np.r_[0, np.cumsum(np.bincount(i, minlength=len(some)))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(cell.astype(np.int32)))
                for rows, cells, is_home, shown_to in ((some, home, 1, lists), (some[i], cell, 0, pa.nulls(len(i), pa.list_(pa.int32())))):
                    own = home if is_home else home[i]
                    values = [np.full(len(rows), d, np.int32), cells.astype(np.int32), np.full(len(rows), is_home, np.int32), own.astype(np.int32), shown_to, rep[rows], copies[rows]]
                    yield pa.RecordBatch.from_arrays([*(v if isinstance(v, pa.Array) else pa.array(v) for v in values), pa.array(raw[rows].tolist(), pa.binary())], names)


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of each block pair: (a, n): the vectors linked to class a; (a, b): edges of a spanning forest."""
    for rows in runs(batches, ["dim", "cell", "hb", "cb"]):
        side, own_cell, rep, copies = (rows.column(c).to_numpy() for c in ("home", "own", "rep", "copies"))
        raw, cell = rows.column("vec").to_pylist(), rows.column("cell")[0].as_py()
        own, other = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        if not len(own) or not len(other):
            continue
        # A guest that sees this cell counts here unless the host sees the guest's, which has the smaller number.
        guests, guest = np.unique(own_cell[other], return_inverse=True)
        lower = guests < cell
        elsewhere = np.zeros((len(own), len(guests)), bool)
        for i, shown in enumerate(rows.column("shown").take(pa.array(own)).to_pylist()):
            elsewhere[i] = np.isin(guests, shown) & lower
        is_guest = own_cell[other] != cell
        x, y = unit([raw[i] for i in own.tolist()]), unit([raw[i] for i in other.tolist()])
        ids, place = np.unique(np.r_[rep[own], rep[other]], return_inverse=True)
        label = np.arange(len(ids))
        mine, theirs = place[: len(own)], place[len(own) :]
        counts, edges = np.zeros(len(ids), np.int64), []
        for a in range(0, len(own), TILE):
            s = x[a : a + TILE] @ y.T
            near = s >= threshold
            for i, j in zip(*np.nonzero(np.abs(s - threshold) < NEAR), strict=True):
                near[i, j] = cosine(raw[own[a + i]], raw[other[j]]) >= threshold
            near &= mine[a : a + TILE, None] != theirs[None, :]
            near &= ~elsewhere[a : a + TILE][:, guest]
            counts[mine[a : a + TILE]] += near @ copies[other]
            counts[theirs] += np.where(is_guest, copies[own[a : a + TILE]] @ near, 0)
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                me, linked = mine[a + i], theirs[near[i]]
                for other_one in linked[np.unique(label[linked], return_index=True)[1]].tolist():
                    if label[other_one] != label[me]:
                        edges.append((ids[me], ids[other_one]))
                        low, high = sorted((label[other_one], label[me]))
                        label[label == high] = low
        keep = np.flatnonzero(counts)
        a = np.r_[ids[keep], np.array([e[0] for e in edges], np.int64)]
        b = pa.array([None] * len(keep) + [int(e[1]) for e in edges], pa.int64())
        n = pa.array(counts[keep].tolist() + [None] * len(edges), pa.int64())
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, n], ["a", "b", "n"])


def cosine(a: bytes, b: bytes) -> float:
    """Of the doubles in a and b, each first divided by its largest, so that no square overflows."""
    x, y = np.frombuffer(a, np.float64), np.frombuffer(b, np.float64)
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)))


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of `vectors` (vec_id long, embedding array of float or double).

    Links: cosine >= threshold, in double precision, between vectors of one length. n_links counts the other rows
    linked directly, component_id is the smallest vec_id reachable, kept says whether it is the row's own. Null, empty
    and zero vectors and those with null or non-finite components link with nothing and are kept. Rows
    with a null vec_id link with nothing, have no component and are not kept. Other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is over 0 and at most 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.put(vectors.select("vec_id", "embedding").mapInArrow(_classed, "vec_id long, k1 long, k2 long, vec binary"), "rows")
    links = F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    classes = rows.where(links).groupBy("k1", "k2").agg(F.min(F.struct("vec_id", "vec")).alias("x"), F.count("*").alias("copies"))
    classes = scratch.put(classes.select("k1", "k2", F.col("x.vec_id").alias("rep"), "copies", F.col("x.vec").alias("vec")), "classes")

    centres: dict[int, np.ndarray] = {}
    for d, n in ((r[0] // 8, r[1]) for r in classes.groupBy(F.length("vec")).count().collect()):  # a row for each length of vector
        k = max(1, min(n // CELL_ROWS, SAMPLE_BYTES // (8 * d * SAMPLE_A_CELL)))
        # Hashes are even: those below this bound are about the sample, so that no task sorts all vectors.
        most = max(SAMPLE_A_CELL * k, min(n, SAMPLE_BYTES // (64 * d)))
        bound = min(2**63 - 1, -(2**63) + 2**64 * (2 * most + 1_000) // n)
        sample = classes.where((F.length("vec") == 8 * d) & (F.xxhash64("k1", "k2") <= bound)).orderBy(F.xxhash64("k1", "k2")).limit(most).select("vec")
        centres[d] = np.frombuffer(sample.coalesce(1).mapInArrow(lambda b, k=k: _fit(b, k), "centres binary").first()[0], np.float64).reshape(-1, d)
    reach = float(np.sqrt(2 - 2 * threshold))
    cells = scratch.put(classes.select("rep", "copies", "vec").mapInArrow(lambda b: _assigned(b, centres, reach), _CELLS), "cells")
    sizes = cells.groupBy("dim", "cell").agg(F.ceil(F.sum("home") / BLOCK_ROWS).cast("int").alias("hbs"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("cbs"))
    sizes = scratch.put(sizes.where("hbs > 0"), "sizes")  # a row for each centre
    tasks = max(tasks, (sizes.agg(F.sum(F.col("hbs") * F.col("cbs"))).first()[0] or 0) // BLOCKS_A_TASK)
    dealt = cells.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("h", F.xxhash64("rep"))
    both = ["own", "rep", "copies", "vec"]
    home = dealt.where("home = 1").select("dim", "cell", F.expr("int(pmod(h, hbs))").alias("hb"), F.explode(F.sequence(F.lit(0), F.col("cbs") - 1)).alias("cb"), F.lit(1).alias("home"), "shown", *both)
    other = dealt.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("hbs") - 1)).alias("hb"), F.expr("int(pmod(h, cbs))").alias("cb"), F.lit(0).alias("home"), F.lit(None).cast("array<int>").alias("shown"), *both)
    blocks = home.unionByName(other).repartition(tasks, "dim", "cell", "hb", "cb").sortWithinPartitions("dim", "cell", "hb", "cb")
    found = scratch.put(blocks.mapInArrow(lambda b: _linked(b, threshold), "a long, b long, n long"), "found")
    scratch.drop("cells")

    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = scratch.put(components(scratch, found.where("b is not null").select("a", "b")), "parts")
    named = classes.select("k1", "k2", "rep", "copies").join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    named = named.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where(links).select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~links).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
