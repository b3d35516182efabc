"""Treebank grammars as rule tables: (kind, parent, a, b, p) with kinds Cr, CC, Cu and X."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import brackets

#: Endings of unknown words, tried in this order (fixed values).
SUFFIXES = ("ing", "ed", "s", "ion", "er", "est", "ly", "ity", "y", "al")
#: Rules without words that a model may hold, as they are sent to every task.
MAX_RULES = 200_000


def suffix_signature(word: str = "word") -> Column:
    """Signature of an unknown word: its ending, else a capital or a digit in front, else ``!unk!``."""
    sig = F.when(F.col(word).endswith(SUFFIXES[0]), "!unk!" + SUFFIXES[0])
    for s in SUFFIXES[1:]:
        sig = sig.when(F.col(word).endswith(s), "!unk!" + s)
    return sig.when(F.col(word).rlike("^[A-Z]"), "!unk!cap").when(F.col(word).rlike("^[0-9]"), "!unk!num").otherwise("!unk!")


def signatures() -> list[str]:
    return ["!unk!" + s for s in (*SUFFIXES, "cap", "num", "")]


def rare_to_signature(words: DataFrame, at_most: int, word: str = "word") -> DataFrame:
    """Replace words seen at most so many times; words that begin with ``*`` stay."""
    n = words.groupBy(word).agg(F.count("*").alias("_n"))
    rare = (F.col("_n") <= at_most) & ~F.col(word).startswith("*")
    return words.join(n, word).withColumn(word, F.when(rare, suffix_signature(word)).otherwise(F.col(word))).drop("_n")


def signature_counts(counts: DataFrame, at_most: int, word: str = "word", n: str = "n") -> DataFrame:
    """word and n of ``rare_to_signature``'s words, from counts of words in parts of a corpus: no word meets its count in a join."""
    whole = counts.groupBy(word).agg(F.sum(n).alias(n))
    rare = (F.col(n) <= at_most) & ~F.col(word).startswith("*")
    return whole.groupBy(F.when(rare, suffix_signature(word)).otherwise(F.col(word)).alias(word)).agg(F.sum(n).alias(n))


def rule_counts(trees: DataFrame) -> DataFrame:
    """kind, parent, a, b and count over binarised trees; broken trees have no rules."""

    def one(text):
        t = brackets.parse(text)
        return [] if t is None else [dict(zip(("kind", "parent", "a", "b"), r)) for r in brackets.rules(brackets.binary(t))]

    made = F.pandas_udf(lambda s: s.map(one), "array<struct<kind:string,parent:string,a:string,b:string>>")
    return trees.select(F.inline(made("tree"))).groupBy("kind", "parent", "a", "b").agg(F.count("*").alias("n"))


def with_unknown(counts: DataFrame, at_most: int = 1) -> DataFrame:
    """Count rare words of the lexicon under their signatures too, so that unseen words have a probability."""
    lexical = counts.where("kind = 'X'")
    total = lexical.groupBy("a").agg(F.sum("n").alias("_t")).where(F.col("_t") <= at_most).select("a")
    rare = lexical.join(total, "a", "left_semi").withColumn("a", suffix_signature("a")).groupBy("kind", "parent", "a", "b").agg(F.sum("n").alias("n"))
    return counts.unionByName(rare)


def normalised(counts: DataFrame, by: tuple[str, ...] = ("parent",), n: str = "n") -> DataFrame:
    """Share ``p`` of a count within its condition; conditions without mass are left out.

    Roots have a condition of their own. Sums are taken by condition first, so a
    frequent one does not meet in a single task.
    """
    keys = [F.when(F.col("kind") == "Cr", "").otherwise(F.col(k)).alias(f"_{k}") for k in by]
    c = counts.select("*", *keys)
    t = c.groupBy(*[f"_{k}" for k in by]).agg(F.sum(n).alias("_t")).where("_t > 0")
    return c.join(t, [f"_{k}" for k in by]).withColumn("p", F.col(n) / F.col("_t")).drop("_t", *[f"_{k}" for k in by])


def pcfg(trees: DataFrame, unknown_at_most: int = 1) -> DataFrame:
    """Relative-frequency grammar of trees."""
    return pcfg_of_counts(rule_counts(trees), unknown_at_most)


def pcfg_of_counts(counts: DataFrame, unknown_at_most: int = 1) -> DataFrame:
    return normalised(with_unknown(counts, unknown_at_most)).select("kind", "parent", "a", "b", "p")


def head_model(rules: DataFrame) -> DataFrame:
    """parent, child and P(child heads parent): rule probability shared equally by a rule's children."""
    binary = rules.where("kind = 'CC'").select("parent", F.explode(F.array("a", "b")).alias("child"), (F.col("p") / 2).alias("p"))
    unary = rules.where("kind = 'Cu'").select("parent", F.col("a").alias("child"), "p")
    s = binary.unionByName(unary).groupBy("parent", "child").agg(F.sum("p").alias("p"))
    return s.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("parent")))


def unary_closure(unary: pd.DataFrame, labels: list[str], steps: int = 19) -> pd.DataFrame:
    """a, b, p: mass of unary chains from a to b of at most ``steps`` rules, the empty chain included."""
    import numpy as np

    at = {x: i for i, x in enumerate(labels)}
    m = np.zeros((len(labels),) * 2)
    for a, b, p in unary.itertuples(index=False):
        m[at[a], at[b]] += p
    total = power = np.eye(len(labels))
    for _ in range(steps):
        power = power @ m
        if not power.any():
            break
        total = total + power
    i, j = total.nonzero()
    return pd.DataFrame({"a": [labels[x] for x in i], "b": [labels[x] for x in j], "p": total[i, j]})


def without_unaries(rules: DataFrame) -> DataFrame:
    """The same grammar without unary rules: chains are put before binary and lexical rules.

    Unary rules pair labels, so their table is bounded by the label set squared
    and not by the corpus; it is gathered after a check of its size. Words stay distributed.
    """
    spark = rules.sparkSession
    unary = rules.where("kind = 'Cu'").select("parent", "a", "p").limit(MAX_RULES + 1).toPandas()
    if len(unary) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} unary rules")
    if unary.empty:
        return rules
    chains = unary_closure(unary, sorted(set(unary["parent"]) | set(unary["a"])))
    chains = spark.createDataFrame(chains, "up string, parent string, q double")
    body = rules.where("kind in ('CC', 'X')")
    lifted = body.join(F.broadcast(chains), "parent", "left").select("kind", F.coalesce("up", "parent").alias("parent"), "a", "b", (F.col("p") * F.coalesce("q", F.lit(1.0))).alias("p"))
    return rules.where("kind = 'Cr'").unionByName(lifted.groupBy("kind", "parent", "a", "b").agg(F.sum("p").alias("p")))
