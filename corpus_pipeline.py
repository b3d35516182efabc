"""A corpus pipeline over ``documents``: toxicity, near copies, benchmark leaks, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vakya.llm import decontaminate, pieces, similar, toxicity
from vakya.llm.common import materialise, table
from vakya.llm.queries import tokenizer_path

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of at least this score are rejected.
TOXIC = 0.3
#: Documents of at least this Jaccard similarity on this many words are near copies.
SIMILARITY, SHINGLE = 0.8, 5


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that score below TOXIC; a null text scores like an empty one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    bad = toxicity.score(docs.where("doc_id is not null"), model).where(F.col("score") >= TOXIC).select("doc_id").distinct()
    return docs.select(DOCUMENTS).join(bad, "doc_id", "left_anti").select(DOCUMENTS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near copies the document with the smallest id; rows without an id stay.

    Five-word shingles; near are a similarity of 0.8 or more, and fingerprints
    of four or fewer differing bits. Rows that repeat a kept id all stay.
    """
    found = similar.similar_components(docs, SIMILARITY, SHINGLE)
    other = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(DOCUMENTS).join(other, "doc_id", "left_anti").select(DOCUMENTS)


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which an item of ``benchmark`` is found."""
    bad = decontaminate.leaks(docs.where("doc_id is not null"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.select(DOCUMENTS).join(bad, "doc_id", "left_anti").select(DOCUMENTS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of every kept document's ids, and the digest of what they decode to."""
    return pieces.encode_documents(docs, pieces.read_model(tokenizer_path("piece_bpe_32k.model")))


STAGES = [("toxicity", toxic), ("simhash", near_copies), ("decontamination", leaked), ("sentencepiece", encoded)]
#: The stages need trained models, fingerprints and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
