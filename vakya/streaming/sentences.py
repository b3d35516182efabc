"""Sentences from growing folders of CoNLL-U files: classified as files arrive, and counted by reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cascade
from ..sources.conllu import parse_blocks


def read_conllu_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Sentences of the CoNLL-U files that arrive in a folder; no order between files.

    ``k`` is a hash of the block, so repeated blocks of a file share it.
    """
    lines = spark.readStream.option("lineSep", "\n\n").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    blocks = lines.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\n+|\n+$", "").alias("block"))
    return parse_blocks(blocks.where("block <> ''").select("file", F.xxhash64("block").alias("k"), "block"))


def classify_stream(sentences: DataFrame, **options) -> DataFrame:
    """Stage and reason of every sentence: the cascade needs no state, so a stream and a table give the same rows."""
    return cascade.classify(sentences, **options)


def write_sentences(classified: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Passed and rejected sentences as Parquet, a sub-folder each by ``outcome``; files appear batch by batch, once each."""
    out = classified.select("file", "sent_id", "text", "stage", "reason", F.when(F.col("stage").isNull(), "passed").otherwise("rejected").alias("outcome"))
    w = out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).partitionBy("outcome").outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def running_counts(classified: DataFrame) -> DataFrame:
    """Sentences by stage so far (null: passed), for the complete or update mode; at most eight rows of state."""
    return classified.groupBy("stage").agg(F.count("*").alias("n"))
