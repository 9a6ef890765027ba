"""A corpus pipeline: quality, near duplicates, contamination, mixture, token files. Each stage keeps or repeats rows of `documents`."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._util import Scratch
from pagemill.llm.decontaminate import decontaminated
from pagemill.llm.jaccard_join import one_per_component
from pagemill.llm.mixing import mixed_rows
from pagemill.llm.quality import fit_on, judges, score_of, training_sample
from pagemill.llm.queries import table, tokenizer_file
from pagemill.llm.token_store import read_tokens, write_tokens

#: A document stays if its quality score reaches this.
LEAST_QUALITY = 0.3
#: A near duplicate: Jaccard similarity of five-word shingles, in percent.
SHINGLE, SIMILAR = 5, 80
#: How often the mixture may go through a source, and the entropy of its weights in nats.
MAX_REPEATS, TARGET_ENTROPY = 4.0, 2.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects. It is fitted on labelled rows of `docs` that training may use.

    Texts that are null or have no words get the score of no features. Without labelled rows of both classes there is nothing
    to judge by: a warning says so, and all rows are kept.
    """
    model = fit_on(training_sample(docs, table(spark, sf_dir, "labels"), "quality"))
    if not judges(model):
        warnings.warn("quality: no labelled documents of both classes; nothing is rejected", stacklevel=2)
        return docs
    return docs.where(score_of(spark, model)(F.col("text")) >= LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of near duplicates."""
    return one_per_component(docs, size=SHINGLE, percent=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which one word in twenty or more lies in windows of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources have their target weights of the same number of tokens."""
    return mixed_rows(docs, target_entropy=TARGET_ENTROPY, max_repeats=MAX_REPEATS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files in doc_id order and returns what they hold: doc_id, ids (end id included), n_tokens, start."""
    path = Scratch(spark, "tokens").path("files")
    write_tokens(docs, path, tokenizer_file())
    return read_tokens(spark.read.parquet(path)).select("doc_id", "start", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The classifier, the components and the tokenizer are beyond SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each written and read again; the last is read from the files that it has written itself."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
