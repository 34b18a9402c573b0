"""From raw documents to packed training sequences, each stage one operator of ledgertone.llm."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgertone.llm import jaccard, packing, passages, rules, toxicity
from ledgertone.llm.common import drop_saved, held_out, rows_where, saved, saved_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Most bytes of a batch that goes to Python: by Spark's own limits, a split of the input is one batch, which the
#: executor and its Python workers would hold several times over.
BATCH_BYTES = 4 << 20

#: What earlier stages saved on the way; it goes when a later stage starts and no longer reads it.
_LEFT: list[str] = []


def _stage(fn: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        drop_saved(spark, _LEFT, still_read=docs)
        before = saved_paths()
        out = fn(spark, docs, sf_dir)
        _LEFT[:] = [p for p in saved_paths() if p in _LEFT or p not in before]
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled documents of sf_dir, scores below 0.5."""
    source, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = held_out("doc_id", 5, 0)
    model = toxicity.fit_on(source.where(~out), labels.where(~out))
    return rows_where(docs, "text", lambda d, text: toxicity.score(d, model, text), "predicted = 0")


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules keep."""
    return rows_where(docs, "text", lambda d, text: rules.judge(d, text_col=text), "kept")


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component linked by five-word shingles at a similarity of 0.8."""
    return jaccard.one_per_component(docs, words=5, percent=80)


@_stage
def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that earlier ones hold."""
    return passages.cut_repeats(docs, min_words=50, size_col="n_chars" if "n_chars" in docs.columns else None)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths up to 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), most=2048, end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_good),
    ("n-gram jaccard join", drop_near_copies),
    ("substring dedup", cut_passages),
    ("packing", pack),
]

#: Models and alignment are beyond SQL; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each result saved and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, "stage")
            _LEFT.append(saved_paths()[-1])
    return docs
