"""The training-data operators against plain Python on small tables, with the cases that break such things."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm.decontaminate import contamination, contamination_summary, decontaminated, words_of
from pagemill.llm.embedding_dedup import near_duplicates
from pagemill.llm.jaccard_join import jaccard_components, one_per_component
from pagemill.llm.licenses import known_licences, license_scan
from pagemill.llm.lm_score import cross_entropy_difference
from pagemill.llm.mixing import entropy, mixed_rows, mixture, temperature, weights_at
from pagemill.llm.quality import fit_on, held_out, scored, training_sample
from pagemill.llm.queries import tokenizer_file
from pagemill.llm.token_counts import at_limit, length_histogram, length_quantiles
from pagemill.llm.token_store import encoded_lengths, ids_digest, read_tokens, write_tokens
from pagemill.llm.warc import LoserTree, merged_index, read_warc, write_warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["ash", "birch", "cedar", "date", "elm", "fir", "gum", "hazel", "ivy", "juniper"]) + str(rng.randint(0, 60)) for _ in range(n))


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [None, "", "  \n\t ", "one", "one", "One  two", "one two three four", words(rng, 30_000)]
    for _ in range(25):
        base = words(rng, rng.choice([8, 20, 60, 200])).split(" ")
        for k in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(k):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 999)}"
            texts += [" ".join(own)] * rng.choice([1, 1, 3])
    return texts


def sets_of(texts, size):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def components_of(sets, percent):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components_match_brute_force(spark, corpus, size, percent):
    sets = sets_of(corpus, size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs_of(spark, corpus), size=size, percent=percent).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, components_of(sets, percent), strict=True))}


@pytest.mark.parametrize("group_rows", [1, 3])
def test_jaccard_groups_that_are_split(spark, corpus, group_rows):
    sets = sets_of(corpus, 4)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs_of(spark, corpus), size=4, percent=85, group_rows=group_rows).collect()}
    assert got == dict(enumerate(components_of(sets, 85)))


def test_jaccard_groups_are_bounded_by_tokens():
    from pagemill.llm.jaccard_join import GROUP_TOKENS, group_parts

    assert group_parts(1_023, 100, 1_024) == 1 and group_parts(10_240, 100, 1_024) == 11
    for n in (1, 5_000, 100_000, 10**7):
        assert (10**6 // group_parts(10**6, n, 1_024) - 1) * n <= GROUP_TOKENS
    assert group_parts(10**6, 90_000, 1_024) == group_parts(10**6, 100_000, 1_024)


def test_jaccard_query_against_brute_force(spark, tmp_path, corpus):
    from pagemill.llm.queries import op5_jaccard_join

    docs_of(spark, corpus).withColumn("grp", F.lit("own")).withColumn("rep", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    sets = sets_of(corpus, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_jaccard_join(spark, str(tmp_path)).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, components_of(sets, 85), strict=True))}


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("grp", F.lit(1)).withColumn("token", F.lit(2))
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_components(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1)]
    assert sorted((r.doc_id or 0) for r in one_per_component(df).collect()) == [0, 1]
    assert one_per_component(df).columns == df.columns
    assert jaccard_components(df.limit(0)).count() == 0


def test_one_per_component_keeps_other_texts_of_a_doc_id(spark):
    rows = [(1, "a b c d e f", "z"), (1, "a b c d e f", "y"), (1, "q r s t u v w", "x"), (1, None, "n"), (2, "A B c d e f", "x"), (3, "m n o p", "x"), (4, "q R s t u v w", "x"), (None, "m n o p", "x")]
    want = [(1, "a b c d e f", "y"), (1, "q r s t u v w", "x"), (1, None, "n"), (3, "m n o p", "x"), (None, "m n o p", "x")]
    got = one_per_component(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def brute_contamination(text, items):
    w = words_of((text or "").encode())
    hit, found = set(), set()
    for name, item in items:
        v = words_of((item or "").encode())
        n = min(13, len(v))
        for i in range(max(0, len(v) - n + 1) if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [500_000, 40])
def test_contamination_matches_brute_force(spark, block):
    rng = random.Random(5)
    items = [(k, words(rng, n)) for k, n in enumerate([13, 20, 40, 5, 1, 2, 14])] + [(7, None), (8, " .. "), (9, "é É ß"), (10, words(rng, 13)), (100, "ash1 " * 15)]
    texts = [None, "", "...", items[0][1].upper(), f"{words(rng, 400)} {items[1][1]}", f"{words(rng, 30)}. {items[2][1][:150]} {words(rng, 9)}", items[3][1], f"{words(rng, 9)} {items[5][1]}", "x é É ß y", "ash1 " * 40, words(rng, 50)]
    texts += [f"{words(rng, 5)} {items[10][1]}"] * 2
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    got = {r[0]: tuple(r)[1:] for r in contamination_summary(contamination(docs, benchmark, block_words=block)).collect()}
    want = {i: brute_contamination(t, items) for i, t in enumerate(texts)}
    assert got == want
    kept = decontaminated(docs.withColumn("hits", F.lit("own")), benchmark, block_words=block)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in want if not want[i][4]]
    assert kept.columns == [*docs.columns, "hits"]
    assert decontaminated(docs, benchmark.limit(0)).count() == len(texts)
    assert contamination(docs.limit(0), benchmark).count() == 0


def test_contamination_of_repetitive_and_long_items(spark):
    from pagemill.llm.decontaminate import Windows, _parts_of

    rng = random.Random(6)
    items = [(0, "ash " * 400), (1, "ash birch " * 150), (2, words(rng, 300)), (3, "ash " * 30)] + [(k, f"the same question as ever {'of all ' * 4}{words(rng, 3)}") for k in range(4, 40)]
    texts = ["ash " * 900, "birch ash " * 90, " ".join(items[2][1].split()[90:140]), items[20][1], "the same question as ever of all of all of all of all"]
    for block in (500_000, 50):
        got = {r[0]: tuple(r)[1:] for r in contamination_summary(contamination(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_words=block)).collect()}
        assert got == {i: brute_contamination(t, items) for i, t in enumerate(texts)}
    long = words_of(words(rng, 500).encode())
    parts = [part for _, part in _parts_of("x", long, 40, 13)]
    assert max(map(len, parts)) <= 40 and {tuple(p[i : i + 13]) for p in parts for i in range(len(p) - 12)} == {tuple(long[i : i + 13]) for i in range(488)}
    # windows that share a prefix are one lookup for each (offset, length)
    windows = Windows([(str(k), words_of(t.encode())) for k, t in items], 13)
    windows.choose(np.ones(len(windows.shingles), np.int64))
    assert max(map(len, windows.prefix.values())) <= 11


def test_contamination_odd_rows(spark):
    rows = [(None, "a b c", "h"), (None, None, "h"), (5, "a b c", "h"), (5, "a b c", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string").withColumn("marks", F.lit(1)).withColumn("row", F.lit("r"))
    benchmark = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = sorted((r.doc_id or 0, r.n_words, r.hits, r["items"]) for r in contamination(docs, benchmark).collect())
    assert got == [(0, 0, [], []), (0, 3, [0, 1], ["1"]), (5, 3, [0, 1], ["1"]), (5, 3, [0, 1], ["1"])]
    assert [r.text for r in decontaminated(docs, benchmark).collect()] == [None] and decontaminated(docs, benchmark).columns == docs.columns


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 100
    rows = [(5, "http://b.example/x", big), (3, "http://A.example/x#f", big), (9, "http://a.example/x", big), (1, "u\r\nv", "small"), (2, None, "small"), (4, "http://a.example/y", None), (6, "http://a.example/y", "WARC/1.1\r\n\r\n" * 30), (7, "http://a.example/y", "WARC/1.1\r\n\r\n" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    write_warc(pages, str(tmp_path / "w"), records=2)
    index = merged_index(read_warc(spark, str(tmp_path / "w")), partitions=3).collect()
    assert [(r.url_key, r.captured, r.page_id) for r in index] == sorted((r.url_key, r.captured, r.page_id) for r in index)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index}
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    want = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h] != i
        want[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None)
    assert got == want
    write_warc(pages.limit(0), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_odd_rows(spark, tmp_path):
    big = 2**63 - 1
    texts = ["x\r\n", "\r\n\r\n" * 40 + "\r", "\r\r\n\r\n\n" * 30, "é" * 3_000_000, "y" * 200]
    rows = [(10**12, "http://a.example/", texts[0]), (10**13, "http://a.example/", texts[1]), (big, "http://a.example/", texts[2]), (-(2**63), "http://a.example/", texts[3]), (None, "http://n.example/", texts[4]), (7, "http://a.example/", texts[4]), (7, "http://a.example/", texts[4]), (8, None, texts[4]), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("own")).withColumn("body", F.lit(1))
    write_warc(pages.coalesce(1), str(tmp_path / "w"))
    index = merged_index(read_warc(spark, str(tmp_path / "w"))).collect()
    assert all(len(r.captured) == 20 for r in index)
    assert [(r.url_key, r.captured) for r in index] == sorted((r.url_key, r.captured) for r in index)
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == texts[4] and i != 7 else "response", 7 if h == texts[4] and i != 7 else None) for i, _, h in rows]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index), key=str) == sorted(want, key=str)
    late = spark.createDataFrame([(1, "u", "h", "+12024-01-01 00:00:00"), (2, "u", "h", None)], "page_id long, url string, html string, t string").select("page_id", "url", "html", F.col("t").cast("timestamp").alias("captured_at"))
    write_warc(late, str(tmp_path / "late"))
    assert sorted(r.captured for r in read_warc(spark, str(tmp_path / "late")).collect()) == ["2024-01-01T00:00:00Z", "9999-12-31T23:59:59Z"]


def test_warc_records_come_in_parts_of_any_size():
    from pagemill.llm.warc import records

    rng = random.Random(2)
    blocks = [bytes(rng.choice(b"\r\n\rab") for _ in range(rng.randint(0, 30))) for _ in range(50)]
    raw = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    for size in (1, 3, 7, 100, len(raw)):
        assert [b for _, _, b in records(raw[i : i + size] for i in range(0, len(raw), size))] == blocks
    places = [at for at, _, _ in records([raw])]
    assert all(raw[at : at + 5] == b"WARC/" for at in places)
    for torn in (raw[:-5], raw[5:], raw[:-4] + b"xxxx"):
        with pytest.raises(ValueError, match="byte"):
            list(records([torn]))


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted((rng.randint(0, 30), i) for _ in range(rng.randint(0, 9))) for i in range(k)]
        assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_temperature_meets_its_targets():
    tokens = [1000, 100, 10]
    shares = [t / 1110 for t in tokens]
    a = temperature(tokens, 1110, target_entropy=0.9)
    assert entropy(weights_at(shares, a)) == pytest.approx(0.9, abs=1e-9)
    b = temperature(tokens, 1110, max_repeats=4.0)
    assert max(w * 1110 / t for w, t in zip(weights_at(shares, b), tokens, strict=True)) == pytest.approx(4.0)
    assert temperature(tokens, 99_999, max_repeats=2.0) == 1.0
    assert temperature([], 0, target_entropy=1.0) == 1.0


def test_mixture_keeps_its_budget(spark):
    rng = random.Random(2)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(600)] + [None, "", words(rng, 5000)]
    sources = ["hot"] * 400 + ["mid"] * 150 + ["low"] * 50 + [None, "void", "mid"]
    docs = docs_of(spark, texts, sources).withColumn("copies", F.lit("own"))
    rows = mixture(docs.drop("copies"), target_entropy=1.0).collect()
    total = {}
    own = {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + r.n_tokens * r.copies
        own[r.source] = own.get(r.source, 0) + r.n_tokens
    n = sum(own.values())
    a = temperature([own[s] for s in ("hot", "low", "mid")], n, target_entropy=1.0, max_repeats=4.0)
    w = dict(zip(("hot", "low", "mid"), weights_at([own[s] / n for s in ("hot", "low", "mid")], a), strict=True))
    for s, x in w.items():
        assert 0 <= x * n - total[s] <= 5001
        copies = {r.copies for r in rows if r.source == s}
        assert max(copies) - min(copies) <= 1
    again = mixed_rows(docs, target_entropy=1.0)
    assert again.columns == docs.columns
    assert again.count() == sum(r.copies for r in rows)
    assert mixture(docs.drop("copies").limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [10_000, 2])
def test_mixture_on_two_levels_and_by_either_join(spark, monkeypatch, broadcast):
    import test_pipeline

    from pagemill.llm import mixing

    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 40)  # thousands of blocks, many in a group
    monkeypatch.setattr(test_pipeline, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(test_pipeline.corpus_pipeline, "TARGET_ENTROPY", 1.3)
    monkeypatch.setattr(test_pipeline.corpus_pipeline, "MAX_REPEATS", 1.5)  # binds
    rng = random.Random(9)
    sources = ["hot"] * 900 + ["a"] * 60 + ["b"] * 60 + ["c"] * 5
    texts = [words(rng, rng.randint(1, 60)) for _ in sources[:-1]] + [None]
    texts[960:1020] = texts[900:960]  # two sources of one total
    docs = docs_of(spark, texts, sources)
    assert temperature([900, 60, 60, 5], 1025, max_repeats=1.5) > temperature([900, 60, 60, 5], 1025, target_entropy=1.3)
    got = {r.doc_id: r.copies for r in mixture(docs, target_entropy=1.3, max_repeats=1.5).collect()}
    want = test_pipeline.copies_of([(i, s, len((t or "").split())) for i, (t, s) in enumerate(zip(texts, sources, strict=True))])
    assert got == {i: want.get(i, 0) for i in range(len(texts))}


def test_mixture_odd_rows(spark):
    rows = [(None, "a b", "s"), (1, "a b", "s"), (1, "a b", "s"), (2, "a b c", None), (3, None, None), (4, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.lit("x")).withColumn("rest", F.lit("x")).withColumn("row", F.lit("x"))
    assert mixture(docs).columns == [*docs.columns, "n_tokens", "block", "copies"]
    rows = mixed_rows(docs, max_repeats=4.0)
    assert rows.columns == docs.columns and rows.count() == 4  # those without tokens get no copies of their own


class PlainModel:
    """A bigram model over plain counts, of (texts, left out or not)."""

    def __init__(self, texts, smaller, size, core=None):
        self.flat = [t.split() for t in texts]
        self.one, self.two, self.first = {}, {}, {}
        self.core, self.size = core, size
        for words_ in self.flat:
            self.add(words_, 1)
        self.smooth = self.total / smaller if smaller else 1.0

    total = 0

    def add(self, words_, sign):
        self.total += sign * len(words_)
        for w in words_:
            self.one[w] = self.one.get(w, 0) + sign
        for h, w in zip(words_, words_[1:], strict=False):
            if self.core is None or (h in self.core and w in self.core):
                self.two[h, w] = self.two.get((h, w), 0) + sign
                self.first[h] = self.first.get(h, 0) + sign

    def loss(self, text, own=False):
        words_ = text.split()
        if own:
            self.add(words_, -1)
        out, last = [], None
        for w in words_:
            p = (self.one.get(w, 0) + self.smooth) / (self.total + self.smooth * self.size)
            if self.first.get(last, 0) > 0:
                p = 0.7 * self.two.get((last, w), 0) / self.first[last] + 0.3 * p
            out.append(-np.log(p))
            last = w
        if own:
            self.add(words_, 1)
        return float(np.mean(out))


def test_cross_entropy_difference_is_that_of_its_models(spark):
    near, back = ["a b a b c", "b a"], ["a b c d e", "e d c b a", None, "rare"]
    asked = ["a b", "d e", None, "", "zzz"]
    got = {r.doc_id: r for r in cross_entropy_difference(docs_of(spark, asked), docs_of(spark, near), docs_of(spark, back), vocabulary_size=5, core=2).collect()}
    capped = lambda t: " ".join(w if w in "abcde" else "?" for w in (t or "").split())
    target, background = (PlainModel([capped(t) for t in texts], 7, 6, core="ab") for texts in (near, back))
    for i in (0, 1, 4):
        x, y = target.loss(capped(asked[i])), background.loss(capped(asked[i]))
        assert got[i].target_loss == pytest.approx(x, rel=1e-9)
        assert got[i].difference == pytest.approx(x - y, rel=1e-9, abs=1e-9)
    assert got[2].n_tokens == 0 and got[2].difference is None and got[3].difference is None
    assert got[0].difference < got[1].difference


def test_cross_entropy_difference_keeps_all_bigrams_and_leaves_rows_out(spark):
    rng = random.Random(4)
    rare = [f"w{i} x{i}" for i in range(2000)]
    texts = [" ".join(rng.choice([*rare, "the"]) if rng.random() < 0.6 else "the" for _ in range(200)) for _ in range(60)] + [None, "", "unheard of"]
    texts += texts[:3]
    near, back, everything = texts[:20], texts[:60], [t or "" for t in texts]
    assert len({w for t in back for w in t.split()}) > 2048  # more than the core words of old
    docs = docs_of(spark, texts)
    for background, own in ((docs_of(spark, back), back), (docs, everything)):
        size = len({w for t in (*near, *own) for w in t.split()}) + 1
        smaller = min(sum(len(t.split()) for t in x) for x in (near, own))
        target_model, background_model = PlainModel(near, smaller, size), PlainModel(own, smaller, size)
        got = {r.doc_id: r for r in cross_entropy_difference(docs, docs_of(spark, near), background, chunk_words=3000).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            if not text:
                assert got[i].n_tokens == 0 and got[i].difference is None
                continue
            assert got[i].n_tokens == len(text.split())
            assert got[i].target_loss == pytest.approx(target_model.loss(text), rel=1e-9)
            assert got[i].background_loss == pytest.approx(background_model.loss(text, own=own is everything), rel=1e-9)


def test_lm_query_against_plain_models(spark, tmp_path):
    from pagemill.llm.queries import op4_lm_score

    rng = random.Random(12)
    texts = [words(rng, rng.randint(1, 40)) for _ in range(40)] + [None, "", "...", words(rng, 20_000)]
    texts += texts[:2]
    docs_of(spark, texts).withColumn("role", F.lit("own")).withColumn("chunk", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(30)] + [(None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    good = {i for i in range(30) if i % 2}
    size = len({w for t in texts for w in (t or "").strip(".").split()}) + 1
    near = [texts[i] for i in sorted(good)]
    smaller = sum(len(t.split()) for t in near)
    target, background = PlainModel(near, smaller, size), PlainModel([(t or "").strip(".") for t in texts], smaller, size)
    for r in op4_lm_score(spark, str(tmp_path)).collect():
        text = (texts[r.doc_id] or "").strip(".")
        if not text:
            assert r.n_tokens == 0 and r.difference is None
            continue
        assert r.target_loss == pytest.approx(target.loss(text, own=r.doc_id in good), rel=1e-9)
        assert r.background_loss == pytest.approx(background.loss(text, own=True), rel=1e-9)


def test_cross_entropy_difference_of_empty_tables(spark):
    docs, none = docs_of(spark, ["a b", None]), docs_of(spark, [])
    for target, background in ((none, docs_of(spark, ["a b c"])), (docs_of(spark, ["a b c"]), none), (none, none)):
        got = {r.doc_id: r for r in cross_entropy_difference(docs, target, background).collect()}
        assert got[1].difference is None and np.isfinite(got[0].difference)
    assert got[0].difference == 0
    assert cross_entropy_difference(none, docs, docs).count() == 0


def test_tokens_round_trip(spark, tmp_path, corpus):
    from tokenizers import Tokenizer

    texts = [*corpus[:40], "<|endoftext|> A<|STARTOFTEXT|>", "I'd  don't.. Ⅷ é́ İ% 東京", "<|startoftext|>x"]
    docs = docs_of(spark, texts).union(docs_of(spark, texts).limit(1))
    write_tokens(docs, str(tmp_path / "t"), tokenizer_file(), files=3)
    stored = read_tokens(spark.read.parquet(str(tmp_path / "t")))
    own = Tokenizer.from_file(tokenizer_file())
    start, want = 0, []
    for i, t in sorted([*enumerate(texts), (0, texts[0])], key=lambda x: x[0]):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in ids_digest(stored).collect()) == sorted(want)
    write_tokens(docs.limit(0), str(tmp_path / "none"), tokenizer_file())
    assert ids_digest(read_tokens(spark.read.schema("doc_id long, ids array<int>, n_tokens long, file_no int, local_start long").parquet(str(tmp_path / "none")))).count() == 0


def test_token_files_are_encoded_and_indexed(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(3)
    docs = docs_of(spark, [words(rng, rng.randint(1, 400)) for _ in range(3000)])
    path = tmp_path / "t"
    write_tokens(docs, str(path), tokenizer_file(), files=2, row_group_bytes=200_000, page_bytes=8_192)
    files = sorted(path.glob("*.parquet"))
    assert len(files) == 2
    ranges = []
    for f in files:
        meta = pq.read_metadata(f)
        assert meta.num_row_groups > 1
        for k in range(meta.num_row_groups):
            group = {meta.row_group(k).column(i).path_in_schema: meta.row_group(k).column(i) for i in range(meta.num_columns)}
            ids = next(c for name, c in group.items() if name.startswith("ids"))
            assert any("DICTIONARY" in e for e in ids.encodings)  # few values repeat
            assert any("DELTA" in e for e in group["doc_id"].encodings) and any("DELTA" in e for e in group["local_start"].encodings)
            assert all(c.has_column_index and c.has_offset_index for c in group.values())
            stats = group["doc_id"].statistics
            ranges.append((stats.min, stats.max))
    assert ranges == sorted(ranges) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))  # row groups part the ids
    # a narrow range of ids opens few row groups, and metadata are read without the ids
    picked = pq.read_table(files[0], columns=["doc_id", "n_tokens"], filters=[("doc_id", "in", [3, 4])])
    assert picked.column("doc_id").to_pylist() == [3, 4] and picked.column_names == ["doc_id", "n_tokens"]
    plan = spark.read.parquet(str(path)).where("doc_id = 7").select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_token_query_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    from pagemill.llm.queries import op6_token_output, op10_token_counts

    rng = random.Random(14)
    texts = [None, "", "I'd  don't.. Ⅷ é́", words(rng, 20_000), *(words(rng, rng.randint(1, 30)) for _ in range(50))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3_000_000_000_000, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("own")).withColumn("ids", F.lit(1)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    own, start, want, lengths = Tokenizer.from_file(tokenizer_file()), 0, [], []
    for i, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        lengths.append(len(ids))
    assert sorted(tuple(r) for r in op6_token_output(spark, str(tmp_path)).collect()) == want
    got = {r.n_tokens: r for r in op10_token_counts(spark, str(tmp_path)).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        within = [x for x in lengths if x <= n]
        assert (r.n_docs, r.docs_within, r.tokens_within) == (lengths.count(n), len(within), sum(within))
        assert (r.docs_over, r.tokens_over) == (len(lengths) - len(within), sum(lengths) - sum(within))
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.rank == pytest.approx(len(within) / len(lengths))


def test_tokens_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (None, None), (1, "b"), (1, "b")], "doc_id long, text string").withColumn("file_no", F.lit("x"))
    write_tokens(docs, str(tmp_path / "t"), tokenizer_file())
    rows = read_tokens(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (0, 2), (1, 2), (1, 2)]
    assert sorted(r.start for r in rows if r.doc_id) == [3, 5]


def test_length_histogram(spark):
    lengths = [1, 1, 5, 2000, 2000, 7, 1024, None]
    df = spark.createDataFrame([(x,) for x in lengths], "n_tokens long")
    known = sorted(x for x in lengths if x is not None)
    hist = length_histogram(df)
    for r in hist.collect():
        assert r.n_docs == known.count(r.n_tokens)
        assert r.docs_within == sum(x <= r.n_tokens for x in known)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in known)
        assert r.tokens_over == sum(x for x in known if x > r.n_tokens)
    got = {r.context_limit: (r.docs_over, r.truncated_tokens) for r in at_limit(hist, [0, 3, 1024, 9999]).collect()}
    assert got == {k: (sum(x > k for x in known), sum(min(x, k) for x in known)) for k in (0, 3, 1024, 9999)}
    assert {r.q: r.n_tokens for r in length_quantiles(hist, [0.5, 1.0]).collect()} == {0.5: 7, 1.0: 2000}
    assert length_histogram(df.limit(0)).count() == 0


def test_encoded_lengths_count_the_end(spark):
    got = {r.doc_id: r.n_tokens for r in encoded_lengths(docs_of(spark, [None, "the cat"]), tokenizer_file()).collect()}
    assert got == {0: 1, 1: 3}


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 8))
    rows = []
    for i in range(160):
        v = base[i % 20] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.3])
        rows.append([float(np.float32(x)) for x in v])
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0], [1e30] * 8, [1e-30] * 8]
    every = rows + odd
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in enumerate(every)], "vec_id long, embedding array<float>, label int")).collect()}
    valid = {}
    for i, v in enumerate(every):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, np.float32).astype(float)
            valid[i] = x / np.abs(x).max()
    up = list(range(len(every)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(every)
    for i, x in valid.items():
        for j, y in valid.items():
            if j < i and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert got == {i: (links[i], root(i), root(i) == i) for i in range(len(every))}


def test_embedding_cells_lose_nothing(spark, monkeypatch):
    from pagemill.llm import embedding_dedup as e

    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    one = sorted(map(tuple, near_duplicates(df).collect()))
    monkeypatch.setattr(e, "CELL_ROWS", 20)
    monkeypatch.setattr(e, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, near_duplicates(df).collect())) == one
    assert max(r[1] for r in one) > 3
    assert near_duplicates(df.limit(0)).count() == 0


def test_embedding_shows_half_the_reach(spark):
    from pagemill.llm import embedding_dedup as e

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres, reach = e.spherical_kmeans(x, 30), float(np.sqrt(2 - 2 * 0.95))
    batch = __import__("pyarrow").RecordBatch.from_pydict({"vec": [v.tobytes() for v in x], "rep": list(range(3000)), "copies": [1] * 3000})
    shown = sum(b.num_rows for b in e._assigned(iter([batch]), {16: centres}, reach)) - 3000
    whole = sum(b.num_rows for b in e._assigned(iter([batch]), {16: centres}, 2 * reach)) - 3000
    assert 0 < shown < 0.6 * whole
    many = e.fitted_centres(x, 400)
    assert 300 < len(many) <= 440 and np.allclose(np.linalg.norm(many, axis=1), 1)


def test_embedding_odd_rows(spark):
    big = [1e200, 1.0, -1e200]
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, big), (4, [v * 1e100 for v in big]), (5, [1.0] * 70_000), (6, [1.0] * 69_999 + [2.0]), (7, [0.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("home", F.lit("x")).withColumn("vec", F.lit(b"x"))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 0, 0, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(4)
    texts = [words(rng, 40) if i % 3 else " ".join(f"{w}###" for w in words(rng, 40).split()) for i in range(300)] + [None, "", "   ", words(rng, 20_000)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    sample = training_sample(docs, labels, "quality")
    out = scored(docs, fit_on(sample)).withColumn("held_out", held_out("doc_id")).collect()
    assert all(0 <= r.score <= 1 for r in out)
    tested = [r for r in out if r.held_out and r.doc_id < 300]
    assert {r.doc_id for r in tested} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(r.score >= 0.3) == bool(r.doc_id % 3) for r in tested]) > 0.95
    assert len({r.score for r in out if r.doc_id in (300, 301, 302)}) == 1
    one = fit_on(training_sample(docs, labels.where("quality = 1"), "quality"))
    assert len({r.score for r in scored(docs, one).collect()}) == 1
    assert scored(docs.limit(0), one).count() == 0


def test_hinge_solver_against_a_plain_one():
    """Dual coordinate descent against projected gradient steps on the same dual, and the ratios against their definition."""
    from pagemill.llm import quality as q

    rng = np.random.default_rng(5)
    dims, n = 12, 40
    rows = [np.sort(rng.choice(dims, rng.integers(1, 7), replace=False)) for _ in range(n)]
    rows[1] = rows[0]  # repeated rows
    values = [rng.normal(size=len(r)) for r in rows]
    y = np.where(rng.random(n) < 0.5, 1.0, -1.0)
    cost = np.where(y > 0, 0.7, 1.3)
    w = q.fit_hinge(rows, values, y, dims, cost=cost, passes=3000, tolerance=1e-9)
    x = np.zeros((n, dims + 1))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r] = v
        x[i, dims] = 1.0
    gram = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(n), 1 / np.linalg.norm(gram, 2)
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
    assert w == pytest.approx(x.T @ (alpha * y), abs=1e-4)
    texts = [(b"good plain words here", 1), (b"good words", 1), (b"BAD!! words", 0)]
    memo = q._Words()
    found = [q.features(t, memo) for t, _ in texts]
    ratio = q._ratios(found, np.array([1.0, 1.0, -1.0]), 1.0)
    counts = {k: np.bincount(np.concatenate([f for f, (_, own) in zip(found, texts, strict=True) if own == k]), minlength=1 << q.FEATURE_BITS) + 1.0 for k in (1, 0)}
    assert ratio == pytest.approx(np.log(counts[1] / counts[1].sum() / (counts[0] / counts[0].sum())))


def test_quality_of_empty_and_useless_tables(spark, tmp_path):
    from pagemill.llm.quality import judges
    from pagemill.llm.queries import op8_quality

    schema = "doc_id long, quality int, toxic int"
    docs = docs_of(spark, ["a b", None, "c", "c"])
    tables = {"empty": [], "null": [(1, None, 0), (None, 1, 0)], "other": [(99, 1, 0), (98, 0, 0)], "repeated": [(i % 4, i % 2, 0) for i in range(40)]}
    for name, rows in tables.items():
        for kind, own in (("none", docs.limit(0)), ("some", docs)):
            at = tmp_path / f"{name}-{kind}"
            own.withColumn("score", F.lit("own")).withColumn("label", F.lit(1)).withColumn("h", F.lit(1)).write.parquet(str(at / "documents.parquet"))
            spark.createDataFrame(rows, schema).withColumn("text", F.lit("own")).write.parquet(str(at / "labels.parquet"))
            got = op8_quality(spark, str(at)).collect()
            assert len(got) == own.count() and all(0 <= r.score <= 1 for r in got)
            if name != "repeated":
                assert all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert not judges(fit_on(training_sample(docs, spark.createDataFrame([], schema), "quality")))


def test_all_queries_on_empty_tables(spark, tmp_path):
    from pagemill.llm.queries import QUERIES

    tables = {"documents": DOCS, "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string"}
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, f in QUERIES.items():
        rows = f(spark, str(tmp_path)).collect()
        assert [r for r in rows if name != "op13_chat_format" or r.conv_id != -7] == [], name  # op13 adds a conversation of its own


def test_licences_odd_rows(spark):
    from pagemill.llm.licence_texts import LICENCES

    mit = LICENCES[0][1]
    docs = spark.createDataFrame([(None, mit), (1, mit), (1, mit), (2, None), (2, "SPDX-License-Identifier: ISC"), (3, "x " * 2_000_000 + "\nSPDX-License-Identifier: ISC")], "doc_id long, text string").withColumn("lines", F.lit("own")).withColumn("license_id", F.lit("own")).withColumn("known_digest", F.lit("own"))
    got = sorted(((r.doc_id or 0, r.license_id or "", r.line_licenses) for r in license_scan(docs, known_licences(spark)).collect()))
    assert got == [(0, "MIT", ""), (1, "MIT", ""), (1, "MIT", ""), (2, "", "ISC"), (2, "ISC", "ISC"), (3, "", "ISC")]
    assert license_scan(docs.limit(0), known_licences(spark)).count() == 0


def test_licences_match_whole_texts(spark):
    from pagemill.llm.licence_texts import LICENCES

    mit = LICENCES[0][1]
    texts = [mit, "  Copyright (c) 2020 Some One\n" + mit.upper().replace("license", "licence"), mit + " more", "Released under the MIT Licence", "one\nReleased under the MIT License.\nLicensed under CC BY 4.0", None, "", "Copyright 2001 X"]
    got = {r.doc_id: (r.license_id, r.line_licenses) for r in license_scan(docs_of(spark, texts), known_licences(spark)).collect()}
    assert got[0][0] == got[1][0] == "MIT" and got[2][0] is None
    assert got[3] == ("MIT", "MIT") and got[4] == (None, "CC-BY-4.0,MIT")
    assert got[5] == got[6] == got[7] == (None, "")
    rows = {r.doc_id: r.canonical_sha256 for r in license_scan(docs_of(spark, texts), known_licences(spark)).collect()}
    assert rows[5] is None and rows[7] is None and rows[0] == rows[1]


def test_licences_match_entire_long_texts(spark):
    from pagemill.llm.licence_texts import ENTIRE

    wanted = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0"}
    assert {k for k, _ in ENTIRE} == wanted
    texts = [t for _, t in ENTIRE] + [t.upper().replace("\n", " \r\n") for _, t in ENTIRE] + [t + "\nand more" for _, t in ENTIRE]
    got = {r.doc_id: r.license_id for r in license_scan(docs_of(spark, texts), known_licences(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == [k for k, _ in ENTIRE] * 2 + [None] * len(ENTIRE)
