"""Centroid clustering of integer vectors; exact distances are worked out only where block norms can't rule a centroid out.

A vector's components are made integers (floor of a power of two times each). Its compressed form has a byte for each component in
steps of its segment, and for each segment the step and the norm of what the bytes leave out. The product of a centroid
with the bytes is off by no more than the sum over segments of that norm times the centroid's (Cauchy-Schwarz), which bounds the squared
distance from below. A vector's exact integer distance to the centroid of the least bound rules out all centroids
whose bound is larger, and only the others get exact distances. Bounds are taken a margin lower than floating point could err, so
assignments are those of exact distances, ties included.

Scale: vectors and compressed forms are staged once. A round is one narrow pass: a task adds up its vectors by cluster, Spark adds up
the tasks' sums, and the driver is handed one row for each centroid and component, whose number the parameters fix.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import Scratch

#: What a bound is lowered by, as a share of the squared norms: many times what doubles are rounded by.
MARGIN = 1e-9
#: Steps from 0 to a segment's largest component.
STEPS = 127
#: Sums travel in pieces of so many bits, so that Spark adds them up exactly whatever their size.
LIMB = 40


def whole_numbers(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of rows of doubles as int64, and which rows are so small that their squared distances fit 63 bits; the others are 0 there."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    small = (np.abs(y) < math.isqrt((1 << 61) // max(1, x.shape[1]))).all(axis=1)
    return np.where(small[:, None], y, 0.0).astype(np.int64), small


def big_numbers(row: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of one row as Python's integers: a double from 2**53 on is an integer itself."""
    return [int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in row.tolist()]


def _cuts(dimension: int, segments: int) -> np.ndarray:
    """Where segments begin; at most one a component."""
    return np.linspace(0, dimension, min(segments, dimension) + 1).astype(int)[:-1]


def segment_norms(x: np.ndarray, segments: int) -> np.ndarray:
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, _cuts(x.shape[1], segments), axis=1))


def restored(codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """What bytes and steps stand for."""
    cuts = _cuts(codes.shape[1], steps.shape[1])
    return codes * np.repeat(steps.astype(np.float64), np.diff(np.r_[cuts, codes.shape[1]]), axis=1)


def compressed(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (rows by components), and for each row its segments' steps and then the norms, rounded up, of what the bytes leave out."""
    cuts = _cuts(x.shape[1], segments)
    steps = (np.maximum.reduceat(np.abs(x).astype(np.float64), cuts, axis=1) / STEPS).astype(np.float32)
    wide = np.repeat(steps.astype(np.float64), np.diff(np.r_[cuts, x.shape[1]]), axis=1)
    codes = np.clip(np.rint(np.divide(x, wide, out=np.zeros(x.shape), where=wide > 0)), -STEPS, STEPS).astype(np.int8)
    rest = segment_norms(x - restored(codes, steps), segments).astype(np.float32)
    return codes, np.concatenate([steps, np.nextafter(rest, np.float32(np.inf))], axis=1)


def lower_bounds(norms: np.ndarray, codes: np.ndarray, forms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Lower bounds (rows by centroids) of squared distances, from compressed vectors and their squared norms."""
    half = forms.shape[1] // 2
    c = centroids.astype(np.float64)
    both = norms[:, None] + (c**2).sum(axis=1)[None]
    return both * (1 - MARGIN) - 2 * (restored(codes, forms[:, :half]) @ c.T + forms[:, half:].astype(np.float64) @ segment_norms(centroids, half).T) - 1


def assigned(x: np.ndarray, codes: np.ndarray, forms: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the first of equal ones), squared distance, and how many exact distances it took, of rows of int64."""
    c = np.array(centroids, np.int64)
    bounds = lower_bounds((x.astype(np.float64) ** 2).sum(axis=1), codes, forms, c)
    cluster = bounds.argmin(axis=1)
    first = cluster.copy()
    best = ((x - c[cluster]) ** 2).sum(axis=1)
    tried = np.ones(len(x), np.int64)
    for j in range(len(c)):
        rows = np.flatnonzero((bounds[:, j] <= best) & (first != j))
        if len(rows):
            d = ((x[rows] - c[j]) ** 2).sum(axis=1)
            nearer = (d < best[rows]) | (d == best[rows]) & (j < cluster[rows])
            cluster[rows[nearer]], best[rows[nearer]] = j, d[nearer]
            tried[rows] += 1
    return cluster, best, tried


def assigned_big(row: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    return min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), j) for j, c in enumerate(centroids))[::-1]


def _rows(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], scale: int) -> Iterator[tuple]:
    """(vec_ids, vectors, cluster, distance, tried) of parts of batches; distances and vectors are Python's integers where they don't fit 63 bits."""
    d = len(centroids[0])
    limit = math.isqrt((1 << 61) // max(1, d))
    plain = all(abs(v) < limit for c in centroids for v in c)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            raw = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            x, small = whole_numbers(raw, scale)
            small &= plain
            rows = np.flatnonzero(small)
            if len(rows):
                forms = part.column("form").flatten().to_numpy(zero_copy_only=False).reshape(len(raw), -1)
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.int8).reshape(-1, d)
                yield (part.column("vec_id").take(pa.array(rows)), x[rows], *assigned(x[rows], codes[rows], forms[rows], centroids))
            for i in np.flatnonzero(~small).tolist():
                own = big_numbers(raw[i], scale)
                cluster, distance = assigned_big(own, centroids)
                yield part.column("vec_id").slice(i, 1), [own], np.array([cluster]), [distance], np.array([len(centroids)])


def limbs(n: int) -> Iterator[tuple[int, int]]:
    """(place, piece) with n the sum of piece << LIMB * place."""
    place = 0
    while not -(1 << LIMB) < n < 1 << LIMB:
        yield place, n & ((1 << LIMB) - 1)
        n, place = n >> LIMB, place + 1
    if n:
        yield place, n


def _sums(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], scale: int) -> Iterator[pa.RecordBatch]:
    """A task's sums: (cluster, place of the component, limb, part); place -1 is the count."""
    totals: dict[int, list[int]] = {}
    for _, x, cluster, *_ in _rows(batches, centroids, scale):
        for j in np.unique(cluster).tolist():
            own = [x[i] for i in np.flatnonzero(cluster == j)] if isinstance(x, list) else x[cluster == j]
            sums = own[0] if isinstance(x, list) else own.sum(axis=0).tolist()
            held = totals.setdefault(j, [0] * (len(centroids[0]) + 1))
            totals[j] = [a + b for a, b in zip(held, [*sums, len(own)], strict=True)]
    rows = [(j, k if k < len(centroids[0]) else -1, place, piece) for j, sums in totals.items() for k, n in enumerate(sums) for place, piece in limbs(n)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "place", "limb", "part"])


def kept_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, embedding) of the vectors with so many components, none null or non-finite."""
    element = vectors.schema["embedding"].dataType.elementType
    own = vectors.select("vec_id", F.col("embedding").cast(T.ArrayType(element if isinstance(element, T.FloatType) else T.DoubleType())))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return own.where(F.col("embedding").isNotNull() & (F.size("embedding") == dimension)).where(~F.exists("embedding", odd))


def centroid_clusters(vectors: DataFrame, *, dimension: int = 64, centroids: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, segments: int = 8) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 and exact_distances of vectors (vec_id, embedding).

    Vectors without exactly `dimension` components, or with a null or non-finite one, are left out. Centroids start as the vectors of the
    least SHA-256 of "seed:vec_id" (then by components); there are fewer if there are fewer vectors, and one without an id is never a start.
    A round assigns each vector to its nearest centroid, the first of equal ones, and then replaces each centroid that has vectors by the floor of
    their mean. Rows that repeat are vectors of their own. Where no vector has an id, cluster and what follows from it are
    null. A distance or sum beyond 63 bits is null; assignments and centroids are exact at any size. Empty: no rows. Other columns are not read.
    `scale` is a power of two, so that products with doubles are exact.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroid-clusters")
    own = kept_vectors(vectors, dimension)
    kind = own.schema["vec_id"].dataType.simpleString()
    floats = own.schema["embedding"].dataType.simpleString()

    def staged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, _ = whole_numbers(part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension), scale)
                codes, forms = compressed(x, segments)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * forms.shape[1]), pa.array(forms.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary()), lists], ["vec_id", "embedding", "codes", "form"])

    table = scratch.put(own.mapInArrow(staged, f"vec_id {kind}, embedding {floats}, codes binary, form array<float>"), "vectors")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = table.where("vec_id is not null").select(place.alias("h"), "embedding").orderBy("h", "embedding").limit(centroids).collect()
    if not starts:
        nothing = F.lit(None)
        return table.select("vec_id", *(nothing.cast(k).alias(n) for n, k in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("exact_distances", "long"))))
    now = [big_numbers(np.array(r.embedding, np.float64), scale) for r in starts]
    for _ in range(rounds):
        parts = table.mapInArrow(lambda b, c=now: _sums(b, c, scale), "cluster int, place int, limb int, part long").groupBy("cluster", "place", "limb").agg(F.sum("part").alias("part"))
        sums = [[0] * (dimension + 1) for _ in now]
        for r in parts.collect():  # at most a row for each centroid, component and limb
            sums[r.cluster][r.place] += r.part << LIMB * r.limb
        after = [[s // n for s in own_sums] if n else old for old, (*own_sums, n) in zip(now, sums, strict=True)]
        if after == now:
            break  # further rounds would change nothing
        now = after

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = lambda d: d if d < 1 << 63 else None
        for ids, _, cluster, distance, tried in _rows(batches, now, scale):
            distance = pa.array([fits(int(d)) for d in distance], pa.int64()) if isinstance(distance, list) else pa.array(distance)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), distance, pa.array(tried)], ["vec_id", "cluster", "distance", "exact_distances"])

    out = scratch.put(table.mapInArrow(final, f"vec_id {kind}, cluster int, distance long, exact_distances long"), "assigned")
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    by = out.groupBy("cluster").agg(total.alias("s")).collect()  # a row a centroid
    long = lambda s: None if s is None or s >= 1 << 63 else int(s)
    every = long(sum(r.s for r in by)) if all(r.s is not None for r in by) else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    known = spark.createDataFrame([(r.cluster, long(r.s), every, digest[r.cluster]) for r in by], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "exact_distances")
