"""Trees from dependencies, text operators over bracketed trees, and span tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import brackets

LEAF = r" ([^ ()]+)\)"


def leaves(tree: str = "tree") -> Column:
    return F.regexp_extract_all(tree, F.lit(LEAF), 1)


def unlabel(tree: str = "tree") -> Column:
    return F.regexp_replace(tree, r"\([^ ()]+", "(X")


def mask_leaves(tree: str = "tree") -> Column:
    return F.regexp_replace(tree, r" [^ ()]+\)", " LEAF!)")


def strip_suffixes(tree: str = "tree") -> Column:
    """Cut labels at their first hyphen or equals sign, unless they begin with one."""
    return F.regexp_replace(tree, r"\(([^ ()=-]+)[-=][^ ()]*", "($1")


def drop_label(tree: str, label: str) -> Column:
    """Remove preterminals of a label."""
    return F.trim(F.regexp_replace(tree, rf" ?\({label} [^ ()]+\)", ""))


def escape_parens(text: str) -> Column:
    return F.replace(F.replace(F.col(text), F.lit("("), F.lit("-LRB-")), F.lit(")"), F.lit("-RRB-"))


def reversed_words(text: str) -> Column:
    return F.array_join(F.reverse(F.split(text, " ")), " ")


def max_words(trees: DataFrame, n: int, tree: str = "tree") -> DataFrame:
    return trees.where(F.size(leaves(tree)) <= n)


def word_counts(trees: DataFrame, tree: str = "tree") -> DataFrame:
    return trees.select(F.explode(leaves(tree)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def lexicon_counts(trees: DataFrame, tree: str = "tree") -> DataFrame:
    pair = F.explode(F.regexp_extract_all(tree, F.lit(r"\(([^ ()]+ [^ ()]+)\)"), 1))
    counts = trees.select(pair.alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    return counts.select(F.split("p", " ")[0].alias("pos"), F.split("p", " ")[1].alias("word"), "n")


def chunk_trees(sentences: DataFrame) -> DataFrame:
    """sent_id, tree: phrases are chunks (misc ChunkId), own tokens first and child chunks after.

    A chunk's label is its id without digits at the end (a name of digits only stays); its head is the first
    token marked ``head``, else its first. Without ids all tokens are one chunk ``none``.
    """

    def tree(tokens) -> str | None:
        rows = [t for t in tokens if t["id"] is not None]
        chunks: dict[str, list] = {}
        for t in rows:
            chunks.setdefault(dict(t["misc"] or {}).get("ChunkId") or "none", []).append(t)
        if not chunks:
            return None
        where = {t["id"]: c for c, ts in chunks.items() for t in ts}
        kids, root = {}, next(iter(chunks))
        for c, ts in chunks.items():
            head = next((t for t in ts if dict(t["misc"] or {}).get("ChunkType", "head") == "head"), ts[0])
            if head["head"] == 0:
                root = c
            elif where.get(head["head"], c) != c:
                kids.setdefault(where[head["head"]], []).append(c)
        seen = set()

        def build(c):
            seen.add(c)
            pos = [t["xpos"] if t["xpos"] not in (None, "", "_") else t["upos"] for t in chunks[c]]
            parts = [f"({p} {t['form']})" for p, t in zip(pos, chunks[c])] + [build(k) for k in kids.get(c, []) if k not in seen]
            return f"({c.rstrip('0123456789') or c} {' '.join(parts)})"

        made = build(root)
        return made if made.startswith("(S ") else f"(S {made})"

    make = F.pandas_udf(lambda s: s.map(tree), "string")
    return sentences.select("sent_id", make("tokens").alias("tree"))


def dependency_trees(sentences: DataFrame) -> DataFrame:
    """sent_id, tree of flat head phrases; rows without a root are left out."""

    @F.pandas_udf("string")
    def make(words: pd.Series, tags: pd.Series, heads: pd.Series) -> pd.Series:
        made = [brackets.of_dependencies(list(w), list(t), [None if pd.isna(x) else int(x) for x in h]) for w, t, h in zip(words, tags, heads)]
        return pd.Series([None if m is None else brackets.show(m) for m in made], dtype=object)

    form = "transform(tokens, t -> replace(replace(t.form, '(', '-LRB-'), ')', '-RRB-'))"
    return sentences.select("sent_id", make(F.expr(form), F.expr("transform(tokens, t -> t.upos)"), F.expr("transform(tokens, t -> t.head)")).alias("tree")).where("tree is not null")


def rewritten(trees: DataFrame, how: str) -> DataFrame:
    """Trees with ``binary`` or ``without_unaries`` applied, or the ``right_branching`` baseline; broken ones become null."""
    step = {"binary": brackets.binary, "without_unaries": brackets.without_unaries, "right_branching": None}[how]

    def one(text):
        t = brackets.parse(text)
        if t is not None and step is None:
            t = brackets.right_branching(_yield(t))
        elif t is not None:
            t = step(t)
        return None if t is None else brackets.show(t)

    return trees.withColumn("tree", F.pandas_udf(lambda s: s.map(one), "string")("tree"))


def _yield(node) -> list[str]:
    return [node[1]] if isinstance(node[1], str) else [w for k in node[1] for w in _yield(k)]


def span_table(trees: DataFrame) -> DataFrame:
    """sent_id, label, l, r, depth of every phrase; broken trees have none."""

    def one(text):
        t = brackets.parse(text)
        return [] if t is None else [dict(zip(("label", "l", "r", "depth"), s)) for s in brackets.spans(t)]

    made = F.pandas_udf(lambda s: s.map(one), "array<struct<label:string,l:int,r:int,depth:int>>")
    return trees.select("sent_id", F.inline(made("tree")))


def span_scores(gold: DataFrame, test: DataFrame, labelled: bool = True) -> DataFrame:
    """tp, fp, fn of spans as multisets over all sentences; each side is counted before they are joined."""
    key = ["sent_id", "l", "r"] + (["label"] if labelled else [])
    g, t = (d.groupBy(*key).agg(F.count("*").alias(n)) for d, n in ((gold, "g"), (test, "t")))
    both = g.join(t, key, "full").select(F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("t", F.lit(0)).alias("t"))
    return both.agg(*[F.coalesce(F.sum(F.expr(e)), F.lit(0)).alias(n) for n, e in (("tp", "least(g, t)"), ("fp", "greatest(t - g, 0)"), ("fn", "greatest(g - t, 0)"))])
