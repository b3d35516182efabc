"""Queries over arrays of many sentences: the same rows as the operators give, from one reading of the documents and without joins."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from vakya.operators import cascade, evaluation, grammar, lines, metrics, orders, recipes, scorers, surprisal, trees, variants
from vakya.plans.barrier import settled
from vakya.recipes_catalog import TAGS
from vakya.sources.treebank import treebank

TEXTS = ["Is this one? No (not) here. " + " ".join(f"word{i} ab" for i in range(30)), "", " \t\r ", "..\n.a..b\n", "x", "one two", "(((", "\u0930\u093e\u092e \u0918\u0930 \u00e4\u00f6\u00fc gehen sofort nach Hause", None,
         "tab\tand\r\nline  end. ", "a\u00a0b c d e", "some\u3000words stand together here today", "*star running Cats 12th x-ray NATO", "\u0130stanbul A\U0001f600B \u0301 last"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder whose documents are odd ones, and ordinary ones by hundreds so that every hash class is there."""
    path = tmp_path_factory.mktemp("odd")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, ". ".join(" ".join("abcdefghij"[: 1 + (i * j + w * w) % 9] for w in range(j)) for j in range(1, 24))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def bank(spark, odd):
    return treebank(spark, odd).cache()


@pytest.fixture(scope="module")
def classified(bank):
    return cascade.classify(bank).cache()


def rows(d):
    return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())


def same(spark, odd, name, want, scans=1):
    """The query's rows, and its plan: so many readings of the documents and no joins or windows over them."""
    made = __spark_entry__.queries()[name](spark, odd)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= scans and "Generate explode(tokens" not in plan
    assert "Window" not in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning(sent_id" not in plan and "Exchange hashpartitioning(doc_id" not in plan
    got, want = rows(made), rows(want.select(*made.columns))
    assert got == want and got


def gold(bank):
    return trees.dependency_trees(bank)


def chunks(bank):
    return trees.chunk_trees(bank)


def tagged(bank):
    tags = "array(" + ", ".join("array(" + ", ".join(f"'{t}'" for t in row) + ")" for row in TAGS) + ")"
    leaf = "transform(tokens, t -> concat('(', t.upos, tags[length(t.form) % 4], ' ', translate(t.form, '()', '[]'), ')'))"
    return bank.withColumn("tags", F.expr(f"{tags}[cast(conv(substr(md5(sent_id), 1, 7), 16, 10) as bigint) % 4]")).select("sent_id", F.expr(f"concat('(S ', array_join({leaf}, ' '), ')')").alias("tree"))


def words(bank):
    return bank.select(F.explode("tokens.form").alias("word"))


def scores(bank, how):
    g = gold(bank)
    return evaluation.bracket_scores(trees.span_table(g), trees.span_table(trees.rewritten(g, how)), g.select("sent_id", F.size(trees.leaves()).alias("words")))


def test_span_scores_right_branching(spark, odd, bank):
    g = gold(bank)
    same(spark, odd, "span_scores_right_branching", metrics.precision_recall(trees.span_scores(trees.span_table(g), trees.span_table(trees.rewritten(g, "right_branching")), labelled=False)))


def test_bracket_difference(spark, odd, bank):
    same(spark, odd, "bracket_difference", evaluation.randomisation_test(scores(bank, "right_branching"), scores(bank, "binary"), iterations=1000), 2)


def test_coins_are_those_of_the_plain_mixing_and_few_at_once():
    ids, mask = np.array([0, 1, 2**63 + 5, 2**64 - 1], np.uint64), 2**64 - 1

    def coin(x, i):
        z = (x + (i + 1) * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        return bool((z ^ (z >> 31)) & 1)

    assert evaluation._coins(ids, 700, 300).tolist() == [[coin(int(x), i) for i in range(700, 1000)] for x in ids]
    # A block's numbers, 8 bytes each, fit a cache of half a megabyte.
    assert evaluation.BLOCK**2 * 8 <= 1 << 19


def test_bracket_summary(spark, odd, bank):
    same(spark, odd, "bracket_summary", evaluation.bracket_summary(scores(bank, "right_branching")))


def test_pcfg_heads(spark, odd, bank):
    want = grammar.head_model(grammar.pcfg(gold(bank)))
    made = __spark_entry__.queries()["pcfg_heads"](spark, odd)
    assert rows(made) == rows(want) and "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()


def test_pcfg_rules(spark, odd, bank):
    want = grammar.without_unaries(grammar.pcfg(gold(bank)))
    made = __spark_entry__.queries()["pcfg_rules"](spark, odd)
    # Counts are read back, not made again by every reader.
    assert rows(made) == rows(want) and "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()


def test_unknown_signatures(spark, odd, bank):
    same(spark, odd, "unknown_signatures", grammar.rare_to_signature(words(bank), 3).groupBy("word").agg(F.count("*").alias("n")))


def test_tree_operations(spark, odd, bank):
    t = tagged(bank)
    want = [recipes.operations_only(t, level).select(F.lit(level).alias("level"), "sent_id") for level in recipes.OPERATIONS]
    same(spark, odd, "tree_operations", want[0].union(want[1]).union(want[2]).union(want[3]))


def test_tree_text(spark, odd, bank):
    same(spark, odd, "tree_text", chunks(bank).select("sent_id", trees.unlabel().alias("unlabelled"), trees.mask_leaves().alias("masked"), trees.drop_label("tree", "PSP").alias("without_psp"), F.array_join(trees.leaves(), " ").alias("words")))


def test_tree_chunks(spark, odd, bank):
    same(spark, odd, "tree_chunks", chunks(bank))


def test_lexicon_counts(spark, odd, bank):
    pair = F.explode(F.regexp_extract_all("tree", F.lit(r"\(([^ ()]+ [^ ()]+)\)"), 1))
    same(spark, odd, "lexicon_counts", chunks(bank).select(pair.alias("p")).groupBy(F.split("p", " ")[0].alias("pos"), F.split("p", " ")[1].alias("word")).agg(F.count("*").alias("n")))


def test_tree_max_words(spark, odd, bank):
    same(spark, odd, "tree_max_words", trees.max_words(chunks(bank), 10))


def test_filter_summary(spark, odd, classified, tmp_path):
    same(spark, odd, "filter_summary", cascade.summary(classified))
    spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert tuple(__spark_entry__.queries()["filter_summary"](spark, str(tmp_path)).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_filter_counts(spark, odd, classified):
    made = __spark_entry__.queries()["filter_counts"](spark, odd)
    assert rows(made) == rows(cascade.filter_counts(classified)) and "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_leaf_word_counts(spark, odd, bank):
    same(spark, odd, "leaf_word_counts", trees.word_counts(chunks(bank)))


def test_filter_rejected(spark, odd, classified):
    same(spark, odd, "filter_rejected", cascade.rejected(classified))
    assert {r["stage"] for r in cascade.rejected(classified).collect()} == set(range(1, 8))


def test_licensed_bigrams(spark, odd, classified):
    same(spark, odd, "licensed_bigrams", variants.licensed_pairs(classified.where("stage is null")))


def test_tree_tags(spark, odd, bank):
    t = tagged(bank).withColumn("marked", recipes.marked_preterminals())
    same(spark, odd, "tree_tags", t.select("sent_id", recipes.without_operators().alias("plain"), recipes.without_scopes().alias("unscoped"), "marked", recipes.unmarked_preterminals("marked").alias("unmarked")))


def test_phrase_histogram(spark, odd, classified):
    same(spark, odd, "phrase_histogram", classified.where("stage is null").groupBy(F.size("constituents").alias("phrases")).agg(F.count("*").alias("n")))


def test_shape_signatures(spark, odd, bank):
    same(spark, odd, "shape_signatures", words(bank).groupBy(lines.shape_signature().alias("signature")).agg(F.count("*").alias("n")))


def test_filter_passed(spark, odd, classified):
    same(spark, odd, "filter_passed", cascade.rendered(cascade.passed_features(classified)))


def test_rule_conversion(spark, odd, bank):
    made = __spark_entry__.queries()["rule_conversion"](spark, odd)
    want = bank.select(F.explode("tokens").alias("t")).select("t.upos", "t.deprel").distinct()
    assert rows(made.select("upos", "deprel").distinct()) == rows(want) and made.count() == 3 * want.count()
    assert "Generate explode(tokens" not in made._jdf.queryExecution().executedPlan().toString()


def test_ending_signatures(spark, odd, bank):
    same(spark, odd, "ending_signatures", words(bank).groupBy(lines.ending_signature().alias("signature")).agg(F.count("*").alias("n")))


def test_tree_validity(spark, odd, bank):
    n = F.length("tree")
    t = tagged(bank).withColumn("tree", F.when(n % 5 == 0, F.replace("tree", F.lit("(S "), F.lit("(S (()) "))).otherwise(F.when(n % 7 == 0, F.substring("tree", 2, 1 << 30)).otherwise(F.col("tree"))))
    same(spark, odd, "tree_validity", recipes.valid_trees(t))


def reordered(bank, classified):
    passed = classified.where("stage is null")
    licence = sorted(f"{r['a']}\t{r['b']}" for r in variants.licensed_pairs(passed).collect())
    return variants.labelled(variants.generate(passed, licence))


def test_variant_pairs(spark, odd, bank, classified):
    same(spark, odd, "variant_pairs", reordered(bank, classified))


def test_orders_are_drawn_as_one_by_one():
    rng = random.Random(5)
    for t in range(40):
        n, cap = rng.choice([2, 4, 5, 7, 8, 9, 10, 13]), rng.choice([99, 5, 600])
        labels, licence = [rng.choice("abc") for _ in range(n)], {f"{a}\t{b}" for a in "abc" for b in "abc" if t % 2 or rng.random() < 0.9}
        ok = np.array([[a == b or f"{x}\t{y}" in licence for b, y in enumerate(labels)] for a, x in enumerate(labels)])
        assert orders.licensed_orders(ok, 42, f"s{t}", cap).tolist() == variants._orders(labels, licence, 42, f"s{t}", cap)


def test_score_dependency_length(spark, odd, bank, classified):
    text = "array_join(transform({0}, x -> cast(x as string)), ',') as {0}"
    want = scorers.dependency_length(reordered(bank, classified)).selectExpr("Sent_ID", "Variant_ID", text.format("Ref_Features"), text.format("Var_Features"), "Delta_DL")
    same(spark, odd, "score_dependency_length", want)


def test_score_information_status(spark, odd, bank, classified):
    want = scorers.information_status(reordered(bank, classified), bank)
    assert {r["IS_Reference"] for r in want.select("IS_Reference").distinct().collect()} >= {0, 1}
    same(spark, odd, "score_information_status", want)


def test_recovered_orders(spark, odd, classified):
    p = settled(classified.where("stage is null"), blocks="transform(constituents, c -> transform(c, t -> t.form))")
    p = settled(p, forms="concat(flatten(reverse(blocks)), transform(filter(tokens, t -> t.id >= root_id), t -> t.form))", blocks="blocks")
    order = F.array_join(F.transform(recipes.recovered_permutation("forms", "blocks"), lambda x: x.cast("string")), ",")
    same(spark, odd, "recovered_orders", p.select("sent_id", order.alias("perm"), F.expr(recipes.block_start("forms", "blocks[0]")).cast("int").alias("first_start")))


def test_sentence_surprisal(spark, odd, bank):
    rules = grammar.without_unaries(grammar.pcfg(gold(bank)))
    texts = bank.select(F.col("text").alias("sent_id")).distinct().withColumn("words", F.split("sent_id", " "))
    bits = surprisal.imputed(surprisal.parse(texts, rules, trees=False).select("sent_id", F.explode("bits").alias("bits")))
    want = bits.groupBy(F.col("sent_id").alias("Sentence")).agg(F.round(F.sum("bits"), 4).alias("bits"), F.count("*").alias("n"))
    made = __spark_entry__.queries()["sentence_surprisal"](spark, odd)
    assert rows(made) == rows(want)
    # A sentence comes back by a hash, in one row; no window over its words, no text as key of a row a word.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(sent_id" not in plan


def test_surprisals_of_many_sentences_are_those_of_one(spark):
    chart = surprisal.Chart(pd.DataFrame([("Cr", "T", "S", "-", 1.0), ("CC", "S", "A", "B", 0.7), ("CC", "S", "A", "S", 0.3)], columns=["kind", "parent", "a", "b", "p"]))
    a, b, none = [("A", 0.6)], [("A", 0.4), ("B", 1.0)], []
    found = chart.surprisals(np.stack([chart._words(x) for x in ([a, a, b], [b, b, b], [a, none, b])]))
    # a a b and b b b have one tree each; after a word without a label nothing goes on.
    assert abs(found[0].sum() + np.log2(0.6 * 0.6 * 0.3 * 0.7)) < 1e-9 and abs(found[1].sum() + np.log2(0.4 * 0.4 * 0.3 * 0.7)) < 1e-9
    assert found[2][1] == np.inf and np.isnan(found[2][2])
    assert chart.surprisal([]) == []
