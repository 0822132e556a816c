"""From raw documents to those worth training on: five stages, each written as Parquet and read again by the next.

Every stage works on all rows of the one before. All but the last return the columns of documents, whatever names others have; the
last adds the digests of encoding and decoding. A stage's result names the scratch tables it is made of (in a column's metadata, which is
stored with it); the next stage, given the stored result, deletes these. ``run`` also deletes a stage's input once its result is stored.

Cases: documents without text or letters go with the first stage; null ids sort after all others and, like rows with equal ids, are
documents of their own; an empty table leaves an empty one; ties and repeated rows follow the rules of the operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from logstrata.llm import decontaminate, exact_dedup, langid, minhash, pieces
from logstrata.llm.common import aside, back, delete, let_go, marked, recorded, scratch, shared_dir, table
from logstrata.llm.queries import HELD_OUT, LANG_FOLDS, piece_model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(function: Stage) -> Stage:
    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        let_go(docs)
        with recorded() as tables:
            found = function(spark, docs, sf_dir)
        return marked(found, tables)

    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: those without text or letters."""
    parser = langid.train(docs.filter(langid.fold_of("doc_id", LANG_FOLDS) != HELD_OUT))
    df, names = aside(docs)
    return back(langid.identify(df, parser, text=names["text"], carry=list(names.values())).filter("lang_pred <> 'und'"), names)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    df, names = aside(docs)
    return back(exact_dedup.exact_dedup(df, text=names["text"], id_column=names["doc_id"], carry=list(names.values())).filter("kept"), names)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8) the document with the smallest doc_id stays."""
    df, names = aside(docs)
    return back(minhash.near_dedup(df, text=names["text"], id_column=names["doc_id"], size=5, percent=80, carry=list(names.values())).filter("kept_row"), names)


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lie in benchmark windows go."""
    df, names = aside(docs)
    return back(decontaminate.decontaminate(df, table(spark, sf_dir, "benchmark"), text=names["text"], keep=list(names.values())).filter(~F.col("contaminated")), names)


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document's id with the digests of its token ids and of their decoding."""
    return pieces.round_trip(docs, piece_model())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", encoded),
]

#: SentencePiece is beyond SQL: tests/llm/test_pipeline.py holds each stage, and all together, against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each stage's result is written to the shared folder before the next reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, step) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        with scratch(spark):
            step(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
