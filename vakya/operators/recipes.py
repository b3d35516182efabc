"""Recipes over lines of text, tagged trees and decision lines; built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Line that starts an article, mark of comments, and what preterminals are marked with (fixed values).
ARTICLE, COMMENT, PRETERMINAL = "!ARTICLE", "%%%%", "-PRTRM"
#: What a tree may not hold to be in a subset of operations (fixed patterns).
OPERATIONS = {
    "AM": (r"-l[NC]", r"\([^ ]*-[hgirv]"),
    "AMC": (r"-l[N]", r"\([^ ]*-[hgirv]"),
    "AMCG": (r"\([^ ]*-[hirv]",),
    "AMCGR": (r"\([^ ]*-[hiv]",),
}
LEAST_TREES = 5


def without_operators(tree: str = "tree") -> Column:
    """Labels without operator tags (-lA) and morphology tags (-x...|...)."""
    return F.regexp_replace(F.regexp_replace(tree, r"[-+]l.(?=[^)]* )", ""), r"-x[^-} ][^ |]*[|][^- ]*", "")


def without_scopes(tree: str = "tree") -> Column:
    """Labels without scope and coreference tags (-n1, +m2)."""
    return F.regexp_replace(tree, r"[-+](?:[nmstw]|nn+)[0-9]+(?=[^)]* )", "")


def operations_only(trees: DataFrame, level: str, tree: str = "tree") -> DataFrame:
    """Trees without operations beyond a level of OPERATIONS; null trees are left out."""
    for pattern in OPERATIONS[level]:
        trees = trees.where(~F.col(tree).rlike(pattern))
    return trees


def operation_levels(trees: DataFrame, tree: str = "tree") -> DataFrame:
    """A row for each level of OPERATIONS that a tree is fit for, with its name; every tree is read once."""
    kept = [F.when(reduce(Column.__and__, [~F.col(tree).rlike(p) for p in patterns]), F.lit(level)) for level, patterns in OPERATIONS.items()]
    return trees.withColumn("level", F.explode(F.array_compact(F.array(*kept))))


def marked_preterminals(tree: str = "tree") -> Column:
    """Preterminals marked, and labels with commas and colons renamed."""
    marked = F.regexp_replace(tree, r"\(([^() ]*) ([^() ]*)\)", f"($1{PRETERMINAL} $2)")
    return F.regexp_replace(F.regexp_replace(marked, r"\([^ ]*,[^ -]*", "(Pc"), r"\(:", "(Pk")


def unmarked_preterminals(tree: str = "tree") -> Column:
    return F.replace(F.col(tree), F.lit(PRETERMINAL), F.lit(""))


def lower_words(line: str = "line") -> Column:
    """Words that begin with a letter or digit in lower case, joined by one blank."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^[\p{L}\p{N}]"), F.lower(w)).otherwise(w)), " ")


def converted_rule(line: str = "line") -> Column:
    """A model line with its initial and unary rules as binary ones, and redundant ^g marks dropped."""
    out = F.regexp_replace(line, r"^Cr : ([^ ]*) =", "CC T : $1 T =")
    return F.regexp_replace(F.regexp_replace(out, r"^Cu ([^ ]*) : ([^ ]*) =", "CC $1 : $2 - ="), r"\^g", "")


def clean_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that aren't comments or article marks; null lines are left out."""
    return lines.where(~F.col(line).contains(COMMENT) & ~F.col(line).contains(ARTICLE))


def line_slice(lines: DataFrame, first: int | None = None, onward: int | None = None, last: int | None = None, by: str = "file", order: str = "k") -> DataFrame:
    """The ``first`` or ``last`` lines of every file, or those from number ``onward`` (from 1)."""
    up, down = Window.partitionBy(by).orderBy(order), Window.partitionBy(by).orderBy(F.desc(order))
    if first is not None:
        return lines.withColumn("_at", F.row_number().over(up)).where(F.col("_at") <= first).drop("_at")
    if onward is not None:
        return lines.withColumn("_at", F.row_number().over(up)).where(F.col("_at") >= onward).drop("_at")
    return lines.withColumn("_at", F.row_number().over(down)).where(F.col("_at") <= last).drop("_at")


def delimited(lines: DataFrame, by: str = "file", order: str = "k", line: str = "line") -> DataFrame:
    """Every file with an article mark in front, number one below its first line, unless it begins with one."""
    first = lines.groupBy(by).agg(F.min_by(line, order).alias(line), F.min(order).alias(order))
    marks = first.where(F.coalesce(F.col(line) != ARTICLE, F.lit(True))).select(by, (F.col(order) - 1).alias(order), F.lit(ARTICLE).alias(line))
    return lines.select(by, order, line).unionByName(marks)


def valid_trees(trees: DataFrame, tree: str = "tree", least: int = LEAST_TREES) -> DataFrame:
    """Trees fit for training: they begin with a bracket and hold no empty node. ValueError for fewer than ``least``."""
    found = trees.where(F.col(tree).startswith("(") & ~F.col(tree).contains("(())"))
    if found.limit(least).count() < least:
        raise ValueError(f"at least {least} trees are needed")
    return found


def decision_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """word, pos, f, j, store and bits of decision lines; header and article lines and those of under six fields are left out.

    Bits that aren't a number are NaN.
    """
    text = F.trim(F.regexp_replace(line, r"\s+", " "))
    rows = lines.where((F.trim(line) != "") & ~F.lower(line).contains("word") & ~F.col(line).contains(ARTICLE)).withColumn("_c", F.split(text, " ")).where(F.size("_c") >= 6)
    kept = [c for c in lines.columns if c != line]
    return rows.select(*kept, *[F.col("_c")[i].alias(n) for i, n in enumerate(("word", "pos", "f", "j", "store"))], F.coalesce(F.expr("try_cast(_c[5] as double)"), F.lit(float("nan"))).alias("bits"))


def block_start(hay: str, needle: str) -> str:
    """SQL text: place (from 0) of the first stretch of ``hay`` that equals ``needle``; -1 if there is none or the needle is empty."""
    return (f"if(size({needle}) = 0 or size({needle}) > size({hay}), -1, "
            f"coalesce(array_min(filter(sequence(0, greatest(size({hay}) - size({needle}), 0)), i -> slice({hay}, i + 1, size({needle})) = {needle})), -1))")


def recovered_permutation(forms: str, constituents: str) -> Column:
    """Order of constituents (arrays of forms) in a surface; the given order if one isn't found. Ties keep the given order."""
    starts = f"transform({constituents}, (c, x) -> named_struct('s', {block_start(forms, 'c')}, 'x', x))"
    return F.expr(f"if(exists({starts}, p -> p.s < 0), transform({constituents}, (c, x) -> x), transform(array_sort({starts}), p -> p.x))")
