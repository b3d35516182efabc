"""Operators over feature lines, model lines and token lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grammar import suffix_signature as ending_signature

#: Features and labels seen less often are backed off (fixed value).
MIN_COUNT = 100
#: Endings that the shape signature marks, tried in this order (fixed values).
SHAPE_SUFFIXES = ("ed", "ing", "ion", "er", "est", "ly", "ity", "y", "al")
#: Word that stands for the start of an article (fixed value).
ARTICLE = "!ARTICLE"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shape_signature(word: str = "word") -> Column:
    """Capitals, digits, dashes and the ending of an unknown word; ASCII letters only, lengths in UTF-8 bytes."""
    w = F.col(word)
    low = F.translate(w, _UPPER, _LOWER)
    caps, size = F.length(F.regexp_replace(w, "[^A-Z]", "")), F.octet_length(w)
    dash, digit = F.contains(w, F.lit("-")), w.rlike("[0-9]")
    case = F.when(w.rlike("^[A-Z]"), F.when(caps == 1, "-INITC").otherwise("-CAPS")).when(~w.rlike("^[A-Za-z]") & (caps > 0), "-CAPS").when(w.rlike("[a-z]"), "-LC").otherwise("")
    ending = F.when(low.endswith("s") & (size >= 3), F.when(low.rlike("[siu]s$"), "").otherwise("-s")).when((size < 5) | dash | (digit & (caps > 0)), "")
    for s in SHAPE_SUFFIXES:
        ending = ending.when(low.endswith(s), "-" + s)
    return F.concat(F.lit("UNK"), case, F.when(digit, "-NUM").otherwise(""), F.when(dash, "-DASH").otherwise(""), ending.otherwise(""))


def min_count_pruned(items: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """Rows of id, features (array) and label with rare features dropped and rare labels backed off.

    A row left without features gets its first one's part before ``&`` with
    ``&bot=1``; a rare label its part before ``&`` with ``&bot``. Counts are
    summed before they are joined. Null features are none; a null label stays.
    """
    each = items.select("id", F.posexplode("features").alias("i", "feature"))
    common = each.groupBy("feature").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("feature")
    kept = each.join(common, "feature").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "feature"))).alias("k")).select("id", F.col("k.feature").alias("kept"))
    labels = items.groupBy("label").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("label", F.lit(True).alias("often"))
    bot = F.array(F.concat(F.substring_index(F.try_element_at("features", F.lit(1)), "&", 1), F.lit("&bot=1")))
    label = F.when(F.col("often"), F.col("label")).otherwise(F.concat(F.substring_index("label", "&", 1), F.lit("&bot")))
    return items.join(kept, "id", "left").join(labels, "label", "left").select("id", F.coalesce("kept", bot).alias("features"), label.alias("label"))


def undersampled(items: DataFrame, negative: Column, rate: float, seed: int = 0, key: str = "id") -> DataFrame:
    """All rows that aren't negative, and a share ``rate`` of those that are, chosen by a hash of the key."""
    coin = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < int(rate * (1 << 20))
    return items.where(~F.coalesce(negative, F.lit(False)) | coin)


def mallet_lines(items: DataFrame) -> DataFrame:
    """id, line: number, label and features without ``=1``, by tabs and spaces."""
    names = F.transform("features", lambda x: F.replace(x, F.lit("=1"), F.lit("")))
    return items.select("id", F.concat_ws("\t", F.col("id").cast("string"), F.col("label"), F.array_join(names, " ")).alias("line"))


def unbalanced(text: str) -> Column:
    """``extra`` if a bracket closes before one opens, ``missing`` if one stays open, else null."""
    marks = F.split(F.regexp_replace(text, "[^()]", ""), "")
    low = F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
                      lambda a, c: F.struct((a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"),
                                            F.least(a["m"], a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("m")))
    return F.when(low["m"] < 0, "extra").when(low["d"] > 0, "missing")


def safe_name(text: str, most: int = 40) -> Column:
    """A name for a file: runs of other characters become ``_``; ``custom_model`` where nothing is left."""
    made = F.substring(F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit(""))), "[^A-Za-z0-9_-]+", "_"), 1, most)
    return F.when(made == "", "custom_model").otherwise(made)


def rooted_tree(text: str = "tree") -> Column:
    """A parser's output with its nameless root called S."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^\(\s*\(", "(S ("), r"\)\s+\)$", "))")


def parsed_rules(lines: DataFrame, line: str = "value") -> DataFrame:
    """kind, parent, a, b, p of model lines ``Kind parent : a b = p``; other lines are left out, absent children are ``-``."""
    m = [F.regexp_extract(line, r"^\s*(\S+)\s+(\S+)\s*:\s*(\S+)(?:\s+(\S+))?\s*=\s*(\S+)\s*$", i) for i in range(1, 6)]
    root = [F.regexp_extract(line, r"^\s*(Cr)\s*:\s*(\S+)\s*=\s*(\S+)\s*$", i) for i in (1, 2, 3)]
    p = F.when(m[0] != "", m[4]).otherwise(root[2]).try_cast("double")
    one = F.when(m[0] != "", F.struct(m[0].alias("kind"), m[1].alias("parent"), m[2].alias("a"), F.when(m[3] == "", "-").otherwise(m[3]).alias("b")))
    one = one.otherwise(F.struct(root[0].alias("kind"), F.lit("T").alias("parent"), root[1].alias("a"), F.lit("-").alias("b")))
    return lines.select(one.alias("r"), p.alias("p")).where("r.kind <> '' and p is not null").select("r.*", "p")


def rule_lines(rules: DataFrame) -> DataFrame:
    """``value`` lines of rules with a positive probability, in order of their text."""
    kids = F.when(F.col("b") == "-", F.col("a")).otherwise(F.concat_ws(" ", "a", "b"))
    head = F.when(F.col("kind") == "Cr", F.lit("Cr")).otherwise(F.concat_ws(" ", "kind", "parent"))
    line = F.concat(head, F.lit(" : "), kids, F.lit(" = "), F.col("p").cast("string"))
    return rules.where("p > 0").select(line.alias("value")).orderBy("value")


def training_rules(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rules of a trained grammar's lines ``parent -> a [b] p``: unary ones of a root are Cr, others Cu, binary CC.

    Roots are labels that are a parent and never a child.
    """
    f = F.split(F.trim(line), r"\s+")
    r = lines.select(f.alias("f")).where("size(f) between 4 and 5 and f[1] = '->'")
    r = r.select(F.col("f")[0].alias("parent"), F.col("f")[2].alias("a"), F.expr("if(size(f) = 5, f[3], '-')").alias("b"), F.expr("try_cast(element_at(f, -1) as double)").alias("p")).where("p is not null")
    child = r.select(F.explode(F.array("a", "b")).alias("parent"), F.col("parent").alias("of")).where("parent <> of").select("parent").distinct()
    roots = r.select("parent").distinct().join(child, "parent", "left_anti").withColumn("root", F.lit(True))
    kind = F.when(F.col("b") != "-", "CC").when(F.col("root"), "Cr").otherwise("Cu")
    return r.join(roots, "parent", "left").select(kind.alias("kind"), F.when(kind == "Cr", "T").otherwise(F.col("parent")).alias("parent"), "a", "b", "p")
