"""Centroid clusters, prefix tries and chat formatting against plain Python, with the cases that break such things."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import centroid_clusters as cc
from pagemill.llm.chat_format import PartVisitor, chat_digests, escaped, format_chats, parts_of, read_chats, turns_of, unescaped
from pagemill.llm.prefix_trie import prefix_trie
from pagemill.llm.queries import CONTROL_TEXT, QUERIES, tokenizer_file
from pagemill.llm.warc import _merged, merged_index, read_warc, write_warc

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["", CONTROL_TEXT, "\\", "\\\\", "#", "### user: x", "</turn>", "</turn>\n### user: y</turn>\n", "<|", "<|image:0|>", "<\\|image:0|>", "a:b: c", "é\U0001f600é", "\r\n", "\0", "</tu", "rn>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- centroid clusters ---------------------------------------------------------------------------------------------


def plain_clusters(vectors, dimension, k, rounds, scale=1024):
    own = [(i, [int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in x]) for i, x in vectors if x is not None and len(x) == dimension and all(v is not None and math.isfinite(v) for v in x)]
    starts = sorted((sha(f"3:{i}"), x) for i, x in own if i is not None)[:k]
    c = [x for _, x in starts]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c)) for _, x in own]

    for _ in range(rounds):
        found = nearest()
        for j in range(len(c)):
            mine = [x for (_, at), (_, x) in zip(found, own, strict=True) if at == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    found = nearest()
    by = {j: sum(d for d, at in found if at == j) for j in range(len(c))}
    long = lambda n: n if n < 1 << 63 else None
    return sorted(((i, j, long(d), long(by[j]), long(sum(by.values())), sha(",".join(map(str, c[j])))) for (i, _), (d, j) in zip(own, found, strict=True)), key=repr)


@pytest.mark.parametrize(("k", "segments"), [(8, 8), (3, 1), (5, 4), (1, 9)])
def test_centroid_clusters_match_plain_rounds(spark, k, segments):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 1) + 3 * (i % 3) for _ in range(4)]) for i in range(120)] + [(1000 + i, [0.5, -0.5, 0.25, 1.0]) for i in range(30)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    out = cc.centroid_clusters(df, dimension=4, centroids=k, rounds=4, segments=segments).drop("exact_distances").collect()
    assert sorted(map(tuple, out), key=repr) == plain_clusters(vectors, 4, k, 4)


def test_centroid_clusters_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [0.0, 0.0]), (None, [5.0, 5.0]), (10, [1e30, -1e30]), (11, [-3.7e38, 1.0]), (12, [-0.0004, 0.0004]), (13, [3e5, 3e5])]
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in vectors], "vec_id long, embedding array<double>, cluster int, form string")
    for k in (3, 1):
        out = cc.centroid_clusters(df, dimension=2, centroids=k, rounds=3).drop("exact_distances").collect()
        assert sorted(map(tuple, out), key=repr) == plain_clusters(vectors, 2, k, 3)
    assert all(r.inertia is None for r in out)  # beyond a long


def test_centroid_clusters_without_starts(spark):
    schema = "vec_id long, embedding array<float>"
    assert cc.centroid_clusters(spark.createDataFrame([], schema), dimension=2).collect() == []
    (row,) = cc.centroid_clusters(spark.createDataFrame([(None, [1.0, 2.0])], schema), dimension=2).collect()
    assert row.cluster is None and row.centroid_sha256 is None
    with pytest.raises(ValueError, match="power of two"):
        cc.centroid_clusters(spark.createDataFrame([], schema), scale=1000)


def test_bounds_are_bounds_and_screen():
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, (500, 64))
    x[:5] = 0
    c = np.concatenate([x[:3], rng.integers(-1000, 1000, (5, 64))])
    exact = ((x[:, None] - c[None]) ** 2).sum(-1)
    codes, forms = cc.compressed(x, 8)
    assert (cc.lower_bounds((x.astype(float) ** 2).sum(1), codes, forms, c) <= exact).all()
    cluster, best, tried = cc.assigned(x, codes, forms, c.tolist())
    assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert tried.mean() < 4  # of eight, of which three are equal


@pytest.mark.parametrize("n", [0, 1, -1, 1 << 40, -(1 << 40), 123456789 << 77, -(987654321 << 90) + 5])
def test_sums_travel_in_limbs(n):
    assert sum(piece << cc.LIMB * place for place, piece in cc.limbs(n)) == n


# --- prefix trie ---------------------------------------------------------------------------------------------------


def plain_trie(rows):
    turns = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids.get(s, [])) or 1
        saved[s] = sum(saved[k] for k in kids.get(s, [])) + (len(members[s]) - 1) * (len(s[-1][1]) if s else 0)
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids.get(s, [])), leaves[s], saved[s], sha(",".join(map(str, sorted(ends.get(s, [])))))) for s, m in members.items()), key=repr)


def conversations(rng, n, long=0):
    rows = []
    for c in range(n):
        shared = rng.randint(0, 4)
        length = long if c == 7 and long else rng.randint(1, 9)
        for t in range(length):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {0 if t < shared else rng.randint(0, 2)} é"))
    return rows


@pytest.mark.parametrize("most", [50_000, 1, 7])
def test_prefix_trie_matches_brute_force(spark, most):
    rows = conversations(random.Random(2), 230, long=400)
    copies = [(5000 + c, t, "user", f"copy {t}") for c in range(80) for t in range(7)]
    chain = [(9000 + c, t, "user", f"chain {t}") for c in range(12) for t in range(c + 8)]
    rows += copies + chain
    out = prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5), most_runs=most).collect()
    assert sorted(map(tuple, out), key=repr) == plain_trie(rows)


def test_prefix_trie_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (3, None, None, None), (3, 1, "user", ""), (3, 1, "user", ""), (3, 1, "assistant", "b"), (4, 1, None, "z" * 100_000), (4, None, "user", None), (250, 0, "user", "x"), (101, 3, "a", "b")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], TURNS + ", depth int, key string")
    assert sorted(map(tuple, prefix_trie(df).collect()), key=repr) == plain_trie(rows)
    assert prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    gone = [(c, t, "user", "x") for c in range(101, 400) for t in range(1)]  # a single turn gives way wherever h > 0
    assert sorted(map(tuple, prefix_trie(spark.createDataFrame(gone, TURNS)).collect()), key=repr) == plain_trie(gone)


# --- chat formatting -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", NASTY + ["".join(NASTY), "".join(reversed(NASTY))])
def test_escaping_is_reversible(text):
    assert unescaped(escaped(text)) == text
    assert not any(x in escaped(text) for x in ("</turn>", "<|", "### "))


def plain_digests(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, own in by.items():
        own.sort()
        loss = "".join(t for *_, r, t in own if r == "assistant")
        out.append((c, len(own), sha("".join(f"{r}\n{t}\n" for *_, r, t in own)), len(loss), sha(loss)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1 << 20, 1, 50])
def test_chats_round_trip(spark, chunk):
    rng = random.Random(9)
    roles = ["user", "assistant", "system", "", "a: b", "###", "x\ny", "</turn>"]
    rows = [(c, t, rng.choice(roles), "".join(rng.choices(NASTY, k=rng.randint(0, 4)))) for c in range(25) for t in range(rng.randint(1, 12))]
    rows += [(None, 0, None, "no id"), (None, 1, "assistant", None), (30, None, "assistant", "null turn"), (30, 0, "assistant", None), (30, 0, "assistant", "tie"), (30, 0, "assistant", "tie"), (31, 5, "assistant", "é" * 200_000)]
    df = spark.createDataFrame([(*r, "p") for r in rows], TURNS + ", formatted string")
    formatted = format_chats(df, chunk=chunk)
    out = [tuple(r)[:5] for r in chat_digests(formatted).collect()]
    assert sorted(out, key=repr) == plain_digests(rows)
    turns = [(r.conv_id, r.role, "".join(p.text for p in r.parts)) for r in read_chats(formatted).collect()]
    assert sorted(turns, key=repr) == sorted(((c, r or "", t or "") for c, _, r, t in rows), key=repr)
    assert chat_digests(format_chats(df.limit(0))).collect() == []


def test_typed_parts_become_placeholders(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    parts = [("text", "see </tu", None, None, None, None, None), ("text", "rn> and", None, None, None, None, None), ("image", None, "s3://a.png", 100, 57, None, None), ("audio", None, "b.wav", None, None, 2.5, None), None, ("document", "left out", "c.pdf", None, None, None, 3), ("odd", "<|image:0|>", None, None, None, None, None), ("image", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", "first ", parts), (1, 1, "assistant", "seen", None), (2, 0, "assistant", None, [])], f"conv_id long, turn long, role string, text string, parts array<{part}>")
    rows = {r.conv_id: r for r in format_chats(df).collect()}
    row = rows[1]
    assert [(a.kind, a.ref, a.tokens, a.turn) for a in row.attachments] == [("image", "s3://a.png", 4 * 3, 0), ("audio", "b.wav", 63, 0), ("document", "c.pdf", 3072, 0), ("image", None, 256, 0)]
    assert all(row.formatted[a.at :].startswith(f"<|{a.kind}:{i}|>") for i, a in enumerate(row.attachments))
    assert row.attachment_tokens == 12 + 63 + 3072 + 256 and row.n_turns == 2
    (_, b, e), (_, lb, le) = turns_of(row.formatted)
    back = parts_of(row.formatted[b:e], [a.asDict() for a in row.attachments])
    assert [p.get("text") or p["ref"] for p in back] == ["first see </turn> and", "s3://a.png", "b.wav", "c.pdf", "<|image:0|>", None]
    assert [(s.start, s.end) for s in row.loss] == [(lb, le)] and row.formatted[lb:le] == "seen"
    assert rows[2].formatted == "### assistant: </turn>\n" and rows[2].loss[0].start == rows[2].loss[0].end
    again = {(r.conv_id, r.turn): r for r in read_chats(format_chats(df)).collect()}
    assert [p.type for p in again[1, 0].parts] == ["text", "image", "audio", "document", "text", "image"] and again[1, 1].in_loss


def test_visitor_merges_texts_before_it_escapes():
    v = PartVisitor()
    assert v.visit(0, 0, "<", [{"type": "text", "text": "|x"}, {"type": "image", "ref": "r"}, {"type": "text", "text": "|"}]) == "<\\|x<|image:0|>|"


def test_broken_chats_are_an_error():
    with pytest.raises(ValueError, match="no turn at character 0"):
        list(turns_of("hello"))
    with pytest.raises(ValueError, match="no turn at character 0"):
        list(turns_of("### user: never ends"))


def test_new_queries_against_plain_versions(spark, tmp_path):
    rng = random.Random(4)
    rows = conversations(rng, 150)
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    vectors = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(64)]) for i in range(60)] + [(60, [1.0]), (61, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = lambda name: sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    assert got("op11_centroid_clusters") == plain_clusters(vectors, 64, 8, 10)
    assert got("op12_prefix_trie") == plain_trie(rows)
    control = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    assert [r[:5] for r in got("op13_chat_format")] == plain_digests(rows + control)


# --- what the last round left open ---------------------------------------------------------------------------------


@pytest.mark.parametrize("end", ["", "\r", "\n", "\r\n", "\r\n\r\n", "\r\n\r", "\r\n\r\n\r\n"])
def test_warc_archives_whose_last_page_ends_in_line_ends(spark, tmp_path, end):
    rows = [(i, f"https://x.com/{i}", f"<p>{i}" + end) for i in range(5)] + [(5, "https://x.com/5", end)]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    out = {r.page_id: (r.payload_bytes, r.payload_digest) for r in read_warc(spark, str(tmp_path / "w")).collect()}
    assert out == {i: (len(h), sha(h)) for i, _, h in rows}


@pytest.mark.parametrize("partitions", [1, 5])
def test_warc_order_with_white_space_around_urls(spark, tmp_path, partitions):
    urls = ["https://b.com/x", "  https://a.com/x", "https://a.com/x\t", " \t https://c.com/x  ", "http://d.com", "https://a.com/\ny", "\thttps://b.com/x "]
    rows = [(i, u, "x" * 200 + str(i)) for i, u in enumerate(urls * 4)]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    index = merged_index(read_warc(spark, str(tmp_path / "w")), partitions=partitions).collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in index]
    assert keys == sorted(keys) and len(keys) == len(rows) and all(r.url == r.url.strip() for r in index)


def test_unsorted_runs_are_an_error():
    kinds = {"run": pa.string(), "at": pa.int64(), "url_key": pa.string(), "captured": pa.string(), "page_id": pa.int64()}
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((["r", "r"], [0, 9], ["b", "a"], ["t", "t"], [1, 2]), kinds.values(), strict=True)], list(kinds))
    with pytest.raises(ValueError, match="no sorted run"):
        list(_merged(iter([batch])))


def test_token_counts_query_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [None, "", "Plain words, here.", "É\u0301 tic-tac <|x|> 12,5", "same", "same", "long " * 3000]
    spark.createDataFrame([(i if i != 4 else None, t, "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(tokenizer_file())
    n = Counter(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in texts)
    out = {r.n_tokens: r.asDict() for r in QUERIES["op10_token_counts"](spark, str(tmp_path)).collect()}
    assert {k: next(v[c] for c in v if c in ("n_docs", "documents", "n_documents")) for k, v in out.items()} == n


def test_lm_ranges_follow_the_words(spark, monkeypatch):
    """More and smaller ranges and chunks give the same scores."""
    from pagemill.llm import lm_score

    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 40)))) for i in range(60)] + [(None, "a b c"), (3, "h g f"), (99, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chunk int")
    target = docs.where("doc_id % 3 = 0")
    score = lambda: sorted(map(tuple, lm_score.cross_entropy_difference(docs, target, docs, chunk_words=200).collect()), key=repr)
    want = score()
    monkeypatch.setattr(lm_score, "RANGE_WORDS", 5)
    assert score() == want and len(want) == len(rows)
