"""From raw documents to packed training sequences, stage by stage.

Every stage works on all the rows the one before it kept and is written before the next one reads it. Then nothing reads
the tables any more that it was made from, and the next one removes them.
"""

from __future__ import annotations

import os
import sys
import threading
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from claimspark.llm import curriculum, exact_dedup, near_dedup, packing, toxicity  # noqa: E402
from claimspark.llm.scratch import new_folder, remove, scratch_folder  # noqa: E402
from claimspark.llm.shipping import ship  # noqa: E402

#: Documents with this score or more go.
TOXIC_FROM = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores stays below ``TOXIC_FROM``; the model learns from ``labels``."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # By number, so that a column of the documents that is called score stays what it is.
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    scored = toxicity.toxicity(numbered, model, text_col=f"c{docs.columns.index('text')}")
    return scored.where(f"score < {TOXIC_FROM}").select(*numbered.columns).toDF(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id."""
    return exact_dedup.without_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest id."""
    ship(spark)
    return near_dedup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order they are due; sources with small weights lose some, others come
    twice."""
    return curriculum.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, and the place of each in a sequence of 4096 tokens.

    A document that the mix takes twice is two rows with one doc_id; doc_row, which rises along the mix, tells them apart.
    ``packing.sequences`` puts the pieces of a sequence together.
    """
    ship(spark)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("doc_row"))
    return packing.pack(packing.token_pieces(rows, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, keep=["doc_row"]))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: In ``folders``, by thread: the application, the stage's place and its folder, of stages whose tables are still there.
_left = threading.local()


def tidy(spark: SparkSession, before: int, docs: DataFrame) -> None:
    """Remove the tables that this thread's stages before a place were made from, if ``docs`` are read from files elsewhere."""
    app, files = spark.sparkContext.applicationId, None
    kept = []
    for made_by, place, folder in getattr(_left, "folders", []):
        if made_by != app:
            continue  # its session is over
        if place < before:
            files = docs.inputFiles() if files is None else files
            if files and not any(f"/{os.path.basename(folder)}/" in f for f in files):
                remove(spark, folder)
                continue
        kept.append((made_by, place, folder))
    _left.folders = kept


def staged(place: int, name: str, stage: Stage) -> Stage:
    """``stage`` with the tables it stores in a folder of its own, which goes when a later stage begins on written rows."""

    @wraps(stage)
    def made(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(spark, place, docs)
        with scratch_folder(spark, f"stage_{name}") as folder:
            _left.folders = [*getattr(_left, "folders", []), (spark.sparkContext.applicationId, place, folder)]
            return stage(spark, docs, sf_dir)

    return made


STAGES = [
    (name, staged(place, name, stage))
    for place, (name, stage) in enumerate(
        [
            ("toxicity", without_toxic),
            ("exact_dedup", without_copies),
            ("near_dedup", without_near_copies),
            ("mixing", mixed),
            ("packing", packed),
        ]
    )
]

#: The first stage learns a model and the last runs a tokenizer, which SQL can't; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    tidy(spark, len(STAGES), docs)
    return docs
