"""Recipes, CoNLL-U reading and recovered orders on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from vakya.operators import cascade, recipes, registry, scorers, trees, variants
from vakya.sources.conllu import load_input, read_conllu

ROW = "{}\tw{}\tw\tNN\t_\t_\t{}\tk1\t_\t_"


def _sentence(n):
    return [ROW.format(i, i, i + 1 if i < n else 0) for i in range(1, n + 1)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_ends_and_blank_lines_with_blanks(spark, tmp_path, end):
    (tmp_path / "a.conllu").write_bytes((end.join(["# sent_id = a", *_sentence(2), " \t", "# sent_id = b", *_sentence(3), "", "", *_sentence(1), ""])).encode())
    got = read_conllu(spark, str(tmp_path / "a.conllu")).orderBy("k").collect()
    assert [(r["sent_id"], len(r["tokens"])) for r in got] == [("a", 2), ("b", 3), ("Unknown_ID", 1)]
    assert all(t["misc"] is None and "\r" not in t["form"] for r in got for t in r["tokens"]) and got[0]["doc_id"].endswith("a.conllu")


def test_load_input(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("\n".join(_sentence(2)) + "\n")
    (tmp_path / "e.conllu").write_text("# nothing\n")
    (tmp_path / "t.txt").write_text("w1 w2\n\nw1\n")

    def parser(text):
        return "\n".join("{}\tw{}\tw\tNN\t_\t_\t0\tk1\t_\t_".format(i, i) for i in range(1, len(text.split()) + 1))

    assert load_input(spark, str(tmp_path / "a.conllu")).count() == 1
    assert sorted(len(r["tokens"]) for r in load_input(spark, str(tmp_path / "t.txt"), parser).collect()) == [1, 2]
    assert len(load_input(spark, "w1 w2 w3", parser).first()["tokens"]) == 3
    for source, error in ((" ", ValueError), (str(tmp_path / "no.conllu"), FileNotFoundError), (str(tmp_path / "e.conllu"), ValueError), ("text", ValueError)):
        with pytest.raises(error):
            load_input(spark, source)


def test_block_start_and_recovered_permutation(spark):
    d = spark.sql("""select * from values (array('a','b','c','d'), array(array('c','d'), array('a'))), (array('a','a','b'), array(array('a'), array('a'), array('b'))),
        (array('a','b'), array(array('b'), array('x'))), (array('a'), array(array('a','b'), array('a'))), (cast(array() as array<string>), array(array('a'))) as t(f, c)""")
    got = [(r["p"], r["s"]) for r in d.select(recipes.recovered_permutation("f", "c").alias("p"), F.expr(recipes.block_start("f", "c[0]")).alias("s")).collect()]
    assert got == [([1, 0], 2), ([0, 1, 2], 0), ([0, 1], 1), ([0, 1], -1), ([0], -1)]


def test_recipes(spark):
    t = spark.createDataFrame([("(NN-lA-n1 x-lAy)",), ("(, ,)",), (None,)], "tree string")
    assert [r[0] for r in t.select(recipes.without_operators()).collect()] == ["(NN-n1 x-lAy)", "(, ,)", None]
    assert [r[0] for r in t.select(recipes.without_scopes()).collect()] == ["(NN-lA x-lAy)", "(, ,)", None]
    assert t.select(recipes.marked_preterminals()).collect()[1][0] == "(Pc-PRTRM ,)"
    with pytest.raises(ValueError):
        recipes.valid_trees(t)
    lines = spark.createDataFrame([(1, 0, "a"), (1, 1, "%%%% b"), (2, 0, "!ARTICLE"), (3, 5, None)], "file int, k int, line string")
    assert sorted((r["file"], r["k"]) for r in recipes.delimited(lines).where("line = '!ARTICLE'").collect()) == [(1, -1), (2, 0), (3, 4)]
    assert [r["line"] for r in recipes.clean_lines(lines).collect()] == ["a"]
    assert [(r["file"], r["k"]) for r in recipes.line_slice(lines, onward=2).collect()] == [(1, 1)]


def test_names_of_digits_stay(spark):
    token = "named_struct('id', 1, 'id_raw', '1', 'form', 'w', 'lemma', 'w', 'upos', 'NN', 'xpos', '_', 'feats', cast(null as map<string,string>), 'head', 0, 'deprel', 'k1', 'deps', '_', 'misc', map('ChunkId', '12'))"
    assert trees.chunk_trees(spark.sql(f"select 's' as sent_id, array({token}) as tokens")).first()["tree"] == "(S (12 (NN w)))"


def test_registered_scorers_and_one_cap_rule(spark, tmp_path, monkeypatch):
    assert {"dependency_length", "information_status"} <= set(registry.names())
    rows = [ROW.format(i, i, 6 if i < 6 else 0).replace("NN", "VM" if i == 6 else "NN") for i in range(1, 7)]
    (tmp_path / "a.conllu").write_text("\n".join(rows) + "\n")
    passed = cascade.classify(read_conllu(spark, str(tmp_path / "a.conllu"))).where("stage is null")
    made = variants.generate(passed, None, 50)
    want = {tuple(r["perm"]) for r in made.collect()}
    assert len(want) == 50
    monkeypatch.setattr(variants, "NATIVE", 2)
    assert {tuple(r["perm"]) for r in variants.generate(passed, None, 50).collect()} == want
    scored = registry.apply(variants.labelled(made), ["dependency_length", "information_status"], corpus=read_conllu(spark, str(tmp_path / "a.conllu")))
    assert {"Delta_DL", "Delta_IS"} <= set(scored.columns) and scored.count() == 50
    assert scorers.SCHEMES["paninian"]["subject"] == ["k1"]
