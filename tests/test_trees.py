"""Trees, grammars and surprisal against brute force on toys."""

import itertools
import math

import pandas as pd

from vakya.functions import brackets
from vakya.operators import grammar, surprisal, trees

TREE = "(S (NP (D a) (N b)) (VP (V c) (NP (N d))))"
# S is A B (0.7) or A S (0.3); A is a (0.6) or b (0.4); B is b. Every sentence is one of a, b, ... and ends in b.
TOY = [("Cr", "T", "S", "-", 1.0), ("CC", "S", "A", "B", 0.7), ("CC", "S", "A", "S", 0.3), ("X", "A", "a", "-", 0.6), ("X", "A", "b", "-", 0.4), ("X", "B", "b", "-", 1.0)]


def test_brackets():
    t = brackets.parse(TREE)
    assert brackets.show(t) == TREE
    assert brackets.spans(t) == [("S", 0, 3, 0), ("NP", 0, 1, 1), ("VP", 2, 3, 1), ("NP", 3, 3, 2)]
    assert [brackets.parse(x) for x in (None, "", "(a", "(a b))", "a")] == [None] * 5
    assert brackets.show(brackets.without_unaries(t)) == "(S (NP (D a) (N b)) (VP (V c) (NP d)))"
    assert brackets.show(brackets.binary(brackets.parse("(S (A a) (B b) (C c))"))) == "(S (A a) (S| (B b) (C c)))"
    assert brackets.show(brackets.right_branching(["a", "b", "c"])) == "(1 (1 a) (1 (1 b) (1 c)))"


def test_text_operators(spark):
    d = spark.createDataFrame([("x", TREE)], "sent_id string, tree string")
    r = d.select(trees.leaves().alias("l"), trees.unlabel().alias("u"), trees.mask_leaves().alias("m"), trees.drop_label("tree", "D").alias("d")).first()
    assert r["l"] == ["a", "b", "c", "d"] and r["u"].startswith("(X (X (X a)") and r["m"].count("LEAF!") == 4 and "(D" not in r["d"]
    assert trees.span_table(d).count() == 4
    base = trees.rewritten(d, "right_branching")
    assert trees.span_scores(trees.span_table(d), trees.span_table(base), labelled=False).first().asDict() == {"tp": 2, "fp": 1, "fn": 2}


def test_chunk_and_dependency_trees(spark):
    from vakya.sources.conllu import TOKEN

    rows = [(1, "बड़ा", "JJ", 2, "NP1"), (2, "घर", "NN", 3, "NP1"), (3, "है", "VM", 0, "VGF1")]
    tokens = [(i, str(i), w, w, t, None, None, h, "x", None, {"ChunkId": c}) for i, w, t, h, c in rows]
    d = spark.createDataFrame([("x", tokens)], f"sent_id string, tokens array<{TOKEN}>")
    # The first token of a chunk is its head here, and hangs on its own chunk.
    assert trees.chunk_trees(d).first()["tree"] == "(S (VGF (VM है)))"
    marked = [(*t[:10], {"ChunkId": t[10]["ChunkId"], "ChunkType": "child" if t[0] == 1 else "head"}) for t in tokens]
    d = spark.createDataFrame([("x", marked)], f"sent_id string, tokens array<{TOKEN}>")
    assert trees.chunk_trees(d).first()["tree"] == "(S (VGF (VM है) (NP (JJ बड़ा) (NN घर))))"
    assert trees.dependency_trees(d).first()["tree"] == "(S (VMP (NNP (JJ बड़ा) (NN घर)) (VM है)))"


def _p(s):
    """Brute force: n words, the last by B, the others by A."""
    if len(s) < 2 or s[-1] != "b":
        return 0.0
    return math.prod(0.6 if x == "a" else 0.4 for x in s[:-1]) * 0.7 * 0.3 ** (len(s) - 2)


def test_surprisal_of_a_toy_grammar(spark):
    rules = spark.createDataFrame(TOY, "kind string, parent string, a string, b string, p double")
    texts = [list(x) for n in (1, 2, 3, 4) for x in itertools.product("ab", repeat=n)]
    d = spark.createDataFrame([("".join(t), t) for t in texts], "sent_id string, words array<string>")
    for r in surprisal.parse(d, rules).collect():
        p, bits = _p(r["sent_id"]), r["bits"]
        assert (r["tree"] is not None) == (p > 0)
        if p:
            assert abs(sum(bits) + math.log2(p)) < 1e-9
            longer = sum(_p("".join(y)) for n in range(1, 12) for y in [(r["sent_id"][0], *x) for x in itertools.product("ab", repeat=n)])
            assert abs(bits[0] + math.log2(longer)) < 1e-4


def test_grammar_of_trees_and_closure(spark):
    d = spark.createDataFrame([("x", TREE), ("y", TREE), ("z", None)], "sent_id string, tree string")
    rules = grammar.pcfg(d, 0)
    sums = {r["k"]: r["s"] for r in rules.groupBy(rules["kind"].eqNullSafe("Cr").alias("root"), rules["parent"].alias("k")).agg({"p": "sum"}).withColumnRenamed("sum(p)", "s").collect()}
    assert all(abs(v - 1) < 1e-12 for v in sums.values())
    plain = {(r["kind"], r["parent"], r["a"]): r["p"] for r in grammar.without_unaries(rules).collect()}
    assert abs(plain["X", "NP", "d"] - 0.25) < 1e-12 and ("X", "N", "b") in plain
    got = surprisal.parse(spark.createDataFrame([("q", ["a", "b", "c", "d"])], "sent_id string, words array<string>"), grammar.without_unaries(rules)).first()
    assert got["tree"] is not None and all(b >= -1e-9 for b in got["bits"])
    c = grammar.unary_closure(pd.DataFrame({"a": ["A"], "b": ["A"], "p": [0.5]}), ["A"])
    assert abs(c["p"][0] - (2 - 0.5**19)) < 1e-12


def test_imputation_and_signatures(spark):
    inf, nan = float("inf"), float("nan")
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 1, inf), ("a", 2, nan), ("a", 3, 3.0), ("b", 0, nan), ("b", 1, inf)], "sent_id string, i int, bits double")
    assert [r["bits"] for r in surprisal.imputed(d).orderBy("sent_id", "i").collect()] == [1.0, 4.5, 2.0, 3.0, 10.0, 11.5]
    w = spark.createDataFrame([("Word",), ("x7",), ("7x",), ("Running",), ("happily",), ("घर",)], "word string")
    assert [r[0] for r in w.select(grammar.suffix_signature()).collect()] == ["!unk!cap", "!unk!", "!unk!num", "!unk!ing", "!unk!ly", "!unk!"]
