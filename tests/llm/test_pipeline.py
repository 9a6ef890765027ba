"""run() of the pipeline against plain Python, stage by stage."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm import brute_contamination, components_of, sets_of, words

from pagemill.llm.mixing import BLOCK_TOKENS, temperature, weights_at
from pagemill.llm.quality import Model, fit_on, training_sample
from pagemill.llm.queries import tokenizer_file


def copies_of(docs):
    """How often the mixture holds each (doc_id, source, tokens), by the same rules, one source at a time."""
    md5 = lambda *parts: hashlib.md5("|".join(map(str, ("0", *parts))).encode()).hexdigest()
    total = {}
    for _, s, n in docs:
        total[s] = total.get(s, 0) + n
    names = sorted(s for s in total if total[s])
    budget = sum(total.values())
    a = temperature([total[s] for s in names], budget, target_entropy=corpus_pipeline.TARGET_ENTROPY, max_repeats=corpus_pipeline.MAX_REPEATS)
    out = {}
    for s, w in zip(names, weights_at([total[s] / budget for s in names], a), strict=True):
        own, n = round(w * budget), total[s]
        passes, rest, blocks = own // n, own % n, max(1, -(-n // BLOCK_TOKENS))
        rows = []
        for i, _, k in (d for d in docs if d[1] == s):
            place = md5(i)
            block = int(place[:8], 16) % blocks
            rows.append((md5(s, block), block, place, i, k))
        used, open_ = 0, rest > 0
        for turn in sorted({r[:2] for r in rows}):
            inside = sorted(r for r in rows if r[:2] == turn)
            whole = used + sum(r[4] for r in inside) <= rest
            for r in inside:
                used += r[4]
                out[r[3]] = passes + (open_ and used <= rest)
            open_ = open_ and whole
    return out


def test_run_matches_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    items = [(k, words(rng, 30)) for k in range(3)]
    texts = []
    for k in range(150):
        text = words(rng, rng.randint(20, 120))
        texts.append(" ".join(f"{w}###" for w in text.split()) if k % 3 == 0 else text)
    texts += [f"{words(rng, 10)} {items[0][1]}", texts[1], f"{texts[2]} tail", texts[4].upper(), None, ""]
    sources = [f"s{min(i % 7, 3)}" for i in range(len(texts))]
    rows = [(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted((r.doc_id, r.start, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = Model(fit_on(training_sample(docs, labels, "quality")))
    kept = [r for r in rows if model.score(r[1].encode() if r[1] else None) >= corpus_pipeline.LEAST_QUALITY]
    assert 0 < len(kept) < len(rows)
    root = components_of(sets_of([r[1] for r in kept], corpus_pipeline.SHINGLE), corpus_pipeline.SIMILAR)
    kept = [r for k, r in enumerate(kept) if root[k] == k]
    kept = [r for r in kept if not brute_contamination(r[1], items)[4]]
    times = copies_of([(r[0], r[3], len((r[1] or "").split())) for r in kept])
    own, start, want = Tokenizer.from_file(tokenizer_file()), 0, []
    for r in kept:
        ids = (*own.encode(r[1] or "", add_special_tokens=False).ids, 2)
        for _ in range(times.get(r[0], 0)):
            want.append((r[0], start, len(ids), ids))
            start += len(ids)
    assert got == want


def test_stages_keep_the_columns(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "token_output"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, hits string"
    empty = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).collect() == []
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_on_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(3)
    texts = [words(rng, 30) for _ in range(6)]
    rows = [(None, texts[0]), (None, None), (1, texts[1]), (1, texts[1]), (1, texts[2]), (2, texts[1]), (3, ""), (4, words(rng, 30_000)), (5, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("grp", F.lit("x"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, texts[3])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality"](spark, docs, str(tmp_path)).columns == docs.columns
    kept = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, texts[0]), (None, None), (1, texts[1]), (1, texts[2]), (3, ""), (4, rows[7][1]), (5, texts[3])], key=str)
    clean = stages["decontamination"](spark, kept, str(tmp_path))
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["1", "1", "3", "4", "None", "None"]
    mixed = stages["mixing"](spark, clean, str(tmp_path))
    assert mixed.columns == docs.columns
    assert stages["token_output"](spark, mixed, str(tmp_path)).count() == mixed.count()
