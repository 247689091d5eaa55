"""Corpus pipeline: documents that a quality classifier keeps, deduplicated, mixed and packed.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over what its
predecessor kept. ``run`` writes each stage's rows to the shared folder and
reads them again, so a lost executor costs at most a stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcount.llm import mixing, near_dup, packing, quality, substring
from quillcount.llm.common import configured, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, learned from the labelled ones of ``docs``, rejects.

    Empty, null and very long texts are scored like others, repeated rows each, equal texts alike; a
    null doc_id is never labelled; without labels of both classes nothing is rejected; an empty table
    stays empty. Here as in the other stages, columns beside those of documents are left out.
    """
    configured(spark)
    stats = staged(quality.with_statistics(docs), "quality-statistics")
    model = quality.fit_labelled(stats, table(spark, sf_dir, "labels"))
    return quality.kept_by_quality(docs.select(*COLUMNS), model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near copies, the document of least id.

    Null and empty texts and rows with a null doc_id stay, as do all rows that share a kept id; very
    long texts are compared whole; an empty table stays empty.
    """
    return near_dup.without_near_copies(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words or more that start at two places; a text that loses all its words goes.

    Null and empty texts stay; repeated rows are copies of each other; very long texts are cut whole;
    an empty table stays empty.
    """
    return substring.without_repeats(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents whole, and of one document for each source a first part, up to the source's target.

    A document that is taken 0 times is not in the mix, so null and empty texts go; n_chars is renewed
    where a part is taken. Null sources form one source; repeated rows are rows of their own; of rows
    with equal keys any may be the one that is cut; an empty table stays empty.
    """
    return mixing.materialised(docs.select(*COLUMNS)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens.

    A null or empty text is one piece, the end id; a very long one as many as it needs; repeated rows
    are packed each; of equally long pieces the lower id goes first; an empty table gives an empty table.
    """
    pieces = staged(packing.pieces(docs), "packing-pieces")
    return packing.packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{k}-{name.split()[0].lower()}")
    return docs


#: The classifier and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
