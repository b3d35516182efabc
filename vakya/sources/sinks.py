"""Sinks: CSV tables, CoNLL-U, tree lines, the JSON summary and model lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cascade
from ..operators.lines import rule_lines
from .conllu import serialise


def write_csv(rows: DataFrame, path: str) -> None:
    """Parts with a header; arrays and structs must be rendered before."""
    rows.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_conllu(sentences: DataFrame, path: str) -> None:
    """Sentences with their ids and texts as comments, a blank line after each."""
    head = F.concat(F.lit("# sent_id = "), F.col("sent_id"), F.lit("\n# text = "), F.regexp_replace("text", r"\s+", " "), F.lit("\n"))
    sentences.select(F.concat(head, serialise(), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_trees(trees: DataFrame, path: str, tree: str = "tree") -> None:
    """One bracketed tree a line; null trees are left out."""
    trees.where(F.col(tree).isNotNull()).select(F.col(tree).alias("value")).write.mode("overwrite").text(path)


def summary_json(classified: DataFrame) -> DataFrame:
    """One row, ``value``: totals, rates, rejections by filter in order, and the phrase histogram as indented JSON."""
    counts = cascade.filter_counts(classified).agg(F.array_sort(F.collect_list(F.struct("stage", "filter", "rejected"))).alias("f"))
    counts = counts.select(F.transform("f", lambda x: F.struct(x["filter"].alias("filter"), x["rejected"].alias("rejected"))).alias("filter_order"))
    # At most one entry for each number of phrases in a sentence.
    sizes = classified.where("stage is null").groupBy(F.size("constituents").alias("p")).agg(F.count("*").alias("n"))
    sizes = sizes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "n")))).alias("phrase_count_distribution"))
    one = cascade.summary(classified).crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(sizes))
    return one.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def write_summary(classified: DataFrame, path: str) -> None:
    summary_json(classified).write.mode("overwrite").text(path)


def write_rules(rules: DataFrame, path: str) -> None:
    """Model lines in order of their text, over as many parts as the sort makes."""
    rule_lines(rules).write.mode("overwrite").text(path)
