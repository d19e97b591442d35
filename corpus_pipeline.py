"""The corpus pipeline: quality, lines, near-duplicates, benchmark passages, packing.

Every stage takes all that its predecessor kept, and returns the columns of documents but for the last, which returns
the packed pieces. Between stages the rows are written as Parquet and read again.

Cases: null texts are scored by the quality stage like empty ones, have no lines, no near-duplicates and no benchmark
passages, and are packed as their end id. Texts that lose all their lines go with them. Rows that repeat a doc_id
count as one document for the near-duplicate stage. Empty tables pass through. Extra columns stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import persisted, read_table
from barloom.llm.decontaminate import decontaminate
from barloom.llm.line_dedup import dedup_lines
from barloom.llm.packing import pack_documents
from barloom.llm.quality import accept, site_columns
from barloom.llm.setsketch import dedup


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return accept(docs, read_table(spark, sf_dir, "labels"), *site_columns())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated cross-site lines; those with nothing left go."""
    out = dedup_lines(docs)
    return out.where((F.col("n_removed") == 0) | (F.trim("text") != "")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets at a similarity of 0.8 or more."""
    return dedup(docs, words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than a twentieth stand in benchmark passages."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), action="document")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and places."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: The trained classifier, the sketches and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
