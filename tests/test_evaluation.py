"""Evaluation and line operators on small fixtures."""

import random

from vakya.operators import evaluation, lines


def test_bracket_scores_and_summary(spark):
    span = "sent_id string, label string, l int, r int"
    gold = spark.createDataFrame([("a", "S", 0, 3), ("a", "NP", 0, 1), ("a", "VP", 2, 3), ("b", "S", 0, 1), ("b", "S", 0, 1)], span)
    test = spark.createDataFrame([("a", "S", 0, 3), ("a", "NP", 1, 2), ("b", "S", 0, 1)], span)
    lengths = spark.createDataFrame([("a", 4), ("b", 50), ("c", 3)], "sent_id string, words int")
    scores = evaluation.bracket_scores(gold, test, lengths)
    got = {r["sent_id"]: (r["gold"], r["produced"], r["matched"], r["crossing"], r["recall"], r["precision"]) for r in scores.collect()}
    assert got == {"a": (3, 2, 1, 1, 1 / 3, 1 / 2), "b": (2, 1, 1, 0, 1 / 2, 1.0), "c": (0, 0, 0, 0, 1.0, 1.0)}
    s = {r["part"]: r for r in evaluation.bracket_summary(scores).collect()}
    assert (s["all"]["sentences"], s["short"]["sentences"]) == (3, 2)
    assert s["all"]["recall"] == 2 / 5 and s["all"]["precision"] == 2 / 3 and s["all"]["f1"] == 4 / 8
    assert s["all"]["complete"] == 1 / 3 and s["all"]["no_crossing"] == 2 / 3 and s["short"]["two_or_less_crossing"] == 1.0


def test_randomisation_finds_a_difference_and_none(spark):
    rng = random.Random(3)
    base = [(f"s{i}", 10, 10, rng.randrange(3, 8)) for i in range(200)]
    schema = "sent_id string, gold int, produced int, matched int"
    a = spark.createDataFrame(base, schema)
    better = spark.createDataFrame([(s, g, p, m + 1) for s, g, p, m in base], schema)
    found = {r["measure"]: r for r in evaluation.randomisation_test(a, better, 300).collect()}
    assert abs(found["recall"]["difference"] - 0.1) < 1e-9 and found["recall"]["p"] == 1 / 301 and found["precision"]["p"] == 1 / 301
    shuffled = evaluation.randomisation_test(a.repartition(5), better.repartition(3), 300)
    assert {r["measure"]: r["p"] for r in shuffled.collect()} == {m: r["p"] for m, r in found.items()}
    same = evaluation.randomisation_test(a, a, 300)
    assert all(r["p"] == 1.0 for r in same.collect())
    assert all(r["p"] == 1.0 for r in evaluation.randomisation_test(a.limit(0), a, 50).collect())


def test_signatures(spark):
    words = {"Running": "UNK-INITC-ing", "NATO": "UNK-CAPS", "cats": "UNK-LC-s", "bus": "UNK-LC", "x-ray": "UNK-LC-DASH", "12th": "UNK-LC-NUM", "3D": "UNK-CAPS-NUM", "": "UNK", "घर": "UNK", "stations": "UNK-LC-s", "quickly": "UNK-LC-ly"}
    d = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r[0]: r[1] for r in d.select("word", lines.shape_signature()).collect()} == words
    short = {"Singing": "!unk!ing", "Bob": "!unk!cap", "7x": "!unk!num", "x7": "!unk!", "Boss": "!unk!s"}
    d = spark.createDataFrame([(w,) for w in short], "word string")
    assert {r[0]: r[1] for r in d.select("word", lines.ending_signature()).collect()} == short


def test_lines(spark):
    items = spark.createDataFrame([(1, ["a&x=1", "b&y=1"], "p&1"), (2, ["a&x=1"], "p&1"), (3, ["c&z=1"], "q&2"), (4, None, None)], "id int, features array<string>, label string")
    got = {r["id"]: (r["features"], r["label"]) for r in lines.min_count_pruned(items, 2).collect()}
    assert got == {1: (["a&x=1"], "p&1"), 2: (["a&x=1"], "p&1"), 3: (["c&bot=1"], "q&bot"), 4: ([None], None)}
    assert lines.mallet_lines(items).where("id = 1").first()["line"] == "1\tp&1\ta&x b&y"
    kept = lines.undersampled(spark.range(2000), lines.F.col("id") % 2 == 0, 0.25).select("id").collect()
    assert sum(r["id"] % 2 for r in kept) == 1000 and 180 < sum(r["id"] % 2 == 0 for r in kept) < 320
    t = spark.createDataFrame([("(a (b))",), ("(a",), ("a)(",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(lines.unbalanced("t")).collect()] == [None, "missing", "extra", None, None]
    t = spark.createDataFrame([(" a b/c ",), ("",), (None,), ("x" * 50,)], "t string")
    assert [r[0] for r in t.select(lines.safe_name("t")).collect()] == ["a_b_c", "custom_model", "custom_model", "x" * 40]
    assert spark.createDataFrame([("( (NP (N x)) )",)], "tree string").select(lines.rooted_tree()).first()[0] == "(S (NP (N x)))"


def test_rule_lines_round_trip(spark):
    rules = [("Cr", "T", "S", "-", 1.0), ("CC", "S", "A", "B", 0.5), ("Cu", "S", "A", "-", 0.25), ("X", "A", "w", "-", 0.0)]
    d = spark.createDataFrame(rules, "kind string, parent string, a string, b string, p double")
    text = lines.rule_lines(d)
    assert [r["value"] for r in text.collect()] == ["CC S : A B = 0.5", "Cr : S = 1.0", "Cu S : A = 0.25"]
    broken = spark.createDataFrame([("nonsense",), (None,), ("X a : b = c",)], "value string")
    assert {tuple(r) for r in lines.parsed_rules(text.union(broken)).collect()} == set(rules[:3])
    trained = spark.createDataFrame([("ROOT -> S 1.0",), ("S -> A B 0.7",), ("S -> A 0.3",), ("x",)], "value string")
    assert {tuple(r) for r in lines.training_rules(trained).collect()} == {("Cr", "T", "S", "-", 1.0), ("CC", "S", "A", "B", 0.7), ("Cu", "S", "A", "-", 0.3)}
