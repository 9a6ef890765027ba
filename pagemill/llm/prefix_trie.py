"""The prefix trie of conversations: nodes are distinct beginnings of turns, with what sharing them saves.

Turns become digests, and a beginning's key is a running sum over its turns' hashes with their places (128 bits); so nodes are a pre-aggregated
group, and copies of a conversation are one path however many there are. Nodes that follow each other with the same
members are one run, told by a running sum as well, so a long conversation is few runs. Runs are hash-partitioned by
first-turn digest; within applyInPandas a task builds pointer dictionaries over its subtries and adds them up in an iterative
postorder. A subtrie of more than MOST_RUNS runs is held back: its top run is set aside and the rest is dealt again by the
digest of the turn that follows it, as often as needed; runs set aside are added up from their children at the end.

Scale: no group is gathered but a forest of bounded size. Running sums go over range partitions, which hand one row on each, so a
conversation with very many turns is many tasks. Ends are packed into pieces of PIECE characters before they meet in their node's digest, a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import Scratch

#: Runs of a subtrie that one task builds, at most.
MOST_RUNS = 50_000
#: Characters of packed ids that travel as one row, about.
PIECE = 1 << 18
#: Of every hundred conversations the first lends its beginning; fewer turns than this of it.
LENDER, MOST_LENT = 100, 6
_SEGMENT = "_segment"


def _ranged(rows: DataFrame, key: str, order: str, scratch: Scratch, name: str) -> DataFrame:
    """`rows` in ranges of (key, order), staged, with the number of their range."""
    return scratch.put(rows.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn(_SEGMENT, F.spark_partition_id()), name)


def _running(rows: DataFrame, key: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """`rows` (of `_ranged`) with running sums, own row included, over the rows of a key. What a range hands on is one row; only the first key of a range is handed any."""
    by = Window.partitionBy(_SEGMENT, key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(key).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(_SEGMENT, key).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    carried = ends.select(_SEGMENT, key, F.count("*").over(along).alias("_before"), *(F.sum(n).over(along).alias(f"_c_{n}") for n in sums)).where("_before > 0").drop("_before")
    out = rows.withColumns({n: F.sum(c).over(by) for n, c in sums.items()}).join(F.broadcast(carried), [_SEGMENT, key], "left")  # at most a row for each range
    return out.withColumns({n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums}).drop(*(f"_c_{n}" for n in sums))


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, chars, last) of each turn of the rebuilt conversations, and (conv_id, length) of all of them.

    A conversation c has the first h turns of conversation c - c % LENDER (as many as there are), then its own turns after its first h; h is the
    CRC-32 of its decimal number, modulo MOST_LENT. Turns are in order of turn (null first), role, text.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    placed = own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("at"), digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    turns = scratch.put(placed.withColumn(_SEGMENT, F.shiftright("at", 33)), "turns")
    turns = scratch.put(_running(turns, "conv_id", "at", {"place": F.lit(1)}).select("conv_id", "place", "digest", "chars"), "placed")
    lent = turns.where((F.col("place") < MOST_LENT) & (F.col("conv_id") % LENDER == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "chars"))).alias("lent"))
    h = F.crc32(F.col("conv_id").cast("string")) % MOST_LENT
    every = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % LENDER}).join(lent, "base", "left")
    lent = F.slice(F.coalesce("lent", F.array().cast("array<struct<place:bigint,digest:string,chars:bigint>>")), F.lit(1), F.col("h").cast("int"))
    every = every.withColumn("lent", lent).withColumn("k", F.size("lent")).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    every = scratch.put(every.select("conv_id", "h", "k", "length", "lent"), "conversations")
    first = every.select("conv_id", "length", F.inline("lent")).select("conv_id", F.col("place").alias("depth"), "digest", "chars", "length")
    rest = turns.join(every.select("conv_id", "h", "k", "length"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("depth"), "digest", "chars", "length")
    return first.unionByName(rest).select("conv_id", "depth", "digest", "chars", (F.col("depth") == F.col("length")).alias("last")), every.select("conv_id", "length")


def keyed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """`turns` with the keys of their node and of its parent: equal for equal beginnings."""
    hashes = [F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth", F.lit("again"))]
    parts = [p for x in hashes for p in (x.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(x, 32))]
    ranged = _ranged(turns.withColumns({f"h{i}": p for i, p in enumerate(parts)}), "conv_id", "depth", scratch, "rebuilt")
    out = _running(ranged, "conv_id", "depth", {f"s{i}": F.col(f"h{i}") for i in range(4)})
    key = lambda depth, *sums: F.unhex(F.md5(F.concat_ws(":", depth, *sums)))
    own = key(F.col("depth"), *(F.col(f"s{i}") for i in range(4)))
    up = F.when(F.col("depth") > 1, key(F.col("depth") - 1, *(F.col(f"s{i}") - F.col(f"h{i}") for i in range(4))))
    return scratch.put(out.select("conv_id", "depth", "digest", "chars", "last", own.alias("key"), up.alias("up")), "keyed")


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: of the decimal conv_ids of each key, in numeric order, comma-joined. Ids are packed where they lie before they meet."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, ids, size = None, 0, [], 0
        for batch in batches:
            rows = []
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (key != held or size >= PIECE):
                    rows.append((held, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    held, first = key, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["key", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["key", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            rows = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids"), strict=True):
                if digest is not None and key == held:
                    digest.update(b"," + ids.as_py().encode())
                    continue
                if digest is not None:
                    rows.append((held, digest.hexdigest()))
                held, digest = key, hashlib.sha256(ids.as_py().encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])], ["key", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    pieces = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(packed, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digested, "key binary, ends_sha256 string")


def forest(runs: pd.DataFrame) -> pd.DataFrame:
    """conv, run, n_leaves and below (what is saved beneath) of the runs of whole subtries: pointer dictionaries, added up children first."""
    place = dict(zip(zip(runs["conv"], runs["bottom"], strict=True), range(len(runs)), strict=True))
    children: dict[int, list[int]] = {}
    tops = []
    for i, up in enumerate(zip(runs["up_conv"], runs["top"] - 1, strict=True)):
        parent = place.get(up)
        (tops if parent is None else children.setdefault(parent, [])).append(i)
    leaves, below = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
    saved = runs["saved"].to_numpy()
    stack = list(tops)
    while stack:
        i = stack[-1]
        own = children.get(i)
        if own and leaves[i] == 0:
            leaves[i] = -1  # its children are on their way
            stack += own
            continue
        stack.pop()
        leaves[i] = leaves[own].sum() if own else 1
        below[i] = (below[own] + saved[own]).sum() if own else 0
    return pd.DataFrame({"conv": runs["conv"], "run": runs["run"], "bottom": runs["bottom"], "top": runs["top"], "up_conv": runs["up_conv"], "saved": saved, "n_leaves": leaves, "below": below})


_RUN = "conv long, run long, bottom long, top long, up_conv long, saved long"


def added_up(runs: DataFrame, turns: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """n_leaves and below of each run (conv, run, bottom, top, up_conv, saved, g, g_top): of a group g whose subtrie begins at depth g_top."""
    done: DataFrame | None = None
    held: list[DataFrame] = []
    work, level = scratch.put(runs, "runs-1"), 1
    while True:
        sizes = work.groupBy("g").agg(F.count("*").alias("size"))
        large = scratch.put(sizes.where(F.col("size") > most).select("g"), f"large-{level}")
        more = bool(large.take(1))
        small = work.join(large, "g", "left_anti") if more else work
        buckets = max(1, -(-small.count() // most))
        # Whole subtries in buckets of about `most` runs; the bucket's number depends on the first-turn digest (and on those that followed it).
        dealt = small.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
        new = dealt.groupBy("bucket").applyInPandas(lambda pdf: forest(pdf), f"{_RUN}, n_leaves long, below long")
        new = scratch.put(new, f"done-{level}")
        done = new if done is None else done.unionByName(new)
        if not more:
            break
        rest = work.join(large, "g", "left_semi")
        top = scratch.put(rest.where("top = g_top"), f"held-{level}")
        held.append(top)
        under = rest.where("top <> g_top").join(top.select("g", F.col("bottom").alias("g_bottom")), "g").withColumn("g_top", F.col("g_bottom") + 1)
        following = turns.select(F.col("conv_id").alias("conv"), F.col("depth").alias("g_top"), "digest")
        again = under.join(following, ["conv", "g_top"]).select(*(c.split()[0] for c in _RUN.split(", ")), F.md5(F.concat("g", "digest")).alias("g"), "g_top")
        level += 1
        work = scratch.put(again, f"runs-{level}")
    for k in range(len(held) - 1, -1, -1):
        own = held[k].select("conv", "run", "bottom", "top", "up_conv", "saved")
        kids = done.select(F.col("up_conv").alias("conv"), (F.col("top") - 1).alias("bottom"), "n_leaves", (F.col("below") + F.col("saved")).alias("below"))
        kids = kids.groupBy("conv", "bottom").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("below").alias("below"))
        done = done.unionByName(scratch.put(own.join(kids, ["conv", "bottom"]), f"added-{k}"))
    return done.select("conv", "run", "n_leaves", "below")


def prefix_trie(conversations: DataFrame, *, most_runs: int = MOST_RUNS) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations (see `rebuilt`): conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Nodes are the distinct sequences of first turns (role, text), from the root without turns. saved_tokens: over the subtree, the sum of
    (members - 1) * code points of the node's last text. ends_sha256: of the ids of the conversations that end there. A null role
    or text is empty, rows that repeat are turns each, and rows without a conv_id are left out. A conversation whose turns
    all give way is a member of the root. Without conversations: no rows. Other columns are not read.
    """
    scratch = Scratch(conversations.sparkSession, "prefix-trie")
    turns, every = rebuilt(conversations, scratch)
    turns = keyed(turns, scratch)
    nodes = turns.groupBy("key").agg(F.min("conv_id").alias("conv"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.first("up").alias("up"), F.count("*").alias("n"))
    nodes = scratch.put(nodes, "nodes")
    kids = nodes.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("key").alias("up"), F.col("conv").alias("up_conv"), F.col("n").alias("up_n"))
    nodes = nodes.join(kids, "key", "left").join(above, "up", "left")
    head = (F.col("depth") == 1) | (F.col("up_n") != F.col("n"))
    nodes = nodes.select("key", "conv", "depth", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), "up_conv", head.cast("long").alias("head"), ((F.col("n") - 1) * F.col("chars")).alias("own"))
    nodes = _running(_ranged(nodes, "conv", "depth", scratch, "linked"), "conv", "depth", {"run": F.col("head"), "upto": F.col("own")})
    nodes = scratch.put(nodes.drop(_SEGMENT, "head"), "run-nodes")
    runs = nodes.groupBy("conv", "run").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("own").alias("saved"), F.min_by("up_conv", "depth").alias("up_conv"), F.max("upto").alias("through"))
    runs = scratch.put(runs, "runs")
    first = turns.where("depth = 1").select(F.col("conv_id").alias("conv"), F.col("digest").alias("g"))
    grouped = runs.drop("through").join(first, "conv").withColumn("g_top", F.lit(1).cast("long"))
    sums = added_up(grouped.select(*(c.split()[0] for c in _RUN.split(", ")), "g", "g_top"), turns, scratch, most_runs)
    sums = runs.select("conv", "run", "through").join(sums, ["conv", "run"])
    out = nodes.join(sums, ["conv", "run"]).select("key", F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", (F.col("through") - F.col("upto") + F.col("own") + F.col("below")).alias("saved_tokens"))
    out = scratch.put(out, "sums")
    members = every.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    tops = out.where("depth = 1").agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    # A first turn's parent is the root, whose smallest member is that of all.
    out = out.withColumn("parent_conv_id", F.when(F.col("depth") > 1, F.col("parent_conv_id")).otherwise(F.lit(members.least)))
    root_key = F.lit(b"")
    root = [(bytearray(), members.least, 0, None, members.n, tops.n, tops.leaves or 1, tops.saved or 0)] if members.n else []
    root = out.sparkSession.createDataFrame(root, out.schema)
    ends = turns.where("last").select("key", "conv_id").unionByName(every.where("length = 0").select(root_key.alias("key"), "conv_id"))
    out = out.unionByName(root).join(digests_of_ends(ends), "key", "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))
