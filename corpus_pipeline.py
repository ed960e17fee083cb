"""A training-data pipeline over ``documents``: quality, near copies, repeated passages, benchmark leaks, packing.

``STAGES`` lists (name, function).  Each function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared checkpoint folder and rereads it as the next one's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, ngram_join, packing, quality_ftrl, repeats
from tabulon.llm.common import read
from tabulon.llm.queries import benchmark_indexes, tokenizer_path
from tabulon.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (a score of 0.5 or more), unchanged; null and empty texts are scored too."""
    weights = quality_ftrl.fit_on_labels(docs, read(spark, sf_dir, "labels"))
    return quality_ftrl.classify(docs, weights, 0.5, keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group that links by five-word shingles at a similarity of 0.8 or more.

    Documents without doc_id stay, as nothing can link to them; rows that repeat a doc_id stay or go together.
    """
    found = ngram_join.similar_components(docs, width=5, percent=80)
    copies = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that a smaller document holds.

    A character that loses one of its bytes goes as a whole.  ``n_chars`` is that of the text that is left; a document
    of which nothing is left stays with an empty text, null becomes empty.
    """
    done = repeats.remove_repeats(docs, 50, carry=["lang", "source"])
    text = F.udf(lambda kept: bytes(kept).decode("utf-8", "ignore"), "string", useArrow=True)
    out = done.withColumn("text", text("kept")).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat or paraphrase no benchmark item."""
    return decontaminate.clean(docs, benchmark_indexes(spark, docs, sf_dir)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of at most 4096 tokens."""
    pieces = packing.token_pieces(docs, tokenizer_path(), 4096)
    return packing.pack(pieces, 4096).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packed),
]

# The classifier, the tokenizer and the latent index have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
