"""One sentence per rejection, precedence, and constituents of hand-built trees."""

from vakya.operators import cascade, variants
from vakya.sources.conllu import read_conllu, serialise

ROWS = {
    "pass": [("राम", "PRP", 4, "k1"), ("घर", "NN", 4, "k2"), ("कल", "RB", 4, "vmod"), ("जाता", "VM", 0, "main"), ("है", "VAUX", 4, "lwg")],
    "question": [("क्या", "WQ", 3, "k1"), ("x", "NN", 3, "k2"), ("v", "VM", 0, "main")],
    "negative": [("a", "NEG", 3, "k1"), ("x", "NN", 3, "k2"), ("v", "VM", 0, "main")],
    "crossing": [("a", "NN", 3, "k1"), ("b", "NN", 4, "k2"), ("c", "VM", 0, "k1"), ("d", "NN", 3, "main")],
    "noroot": [("a", "NN", 2, "k1"), ("b", "VM", 1, "k2")],
    "nominal": [("a", "NN", 3, "k1"), ("b", "NN", 3, "k2"), ("c", "NN", 0, "main")],
    "punct": [("a", "NN", 3, "punct"), ("b", "NN", 3, "k2"), ("c", "VM", 0, "main")],
    "single": [("a", "NN", 2, "k1"), ("c", "VM", 0, "main")],
    "both": [("a", "WQ", 2, "k1"), ("c", "NEG", 0, "main")],
}


def corpus(tmp_path):
    text = ""
    for name, rows in ROWS.items():
        text += f"# sent_id = {name}\n" + "".join(f"{i}\t{f}\t{f}\t{u}\t_\t_\t{h}\t{d}\t_\t_\n" for i, (f, u, h, d) in enumerate(rows, 1)) + "\n"
    text += "# sent_id = ghost\n1\ta\ta\tNN\t_\t_\t3\tk1\t_\t_\n2.1\tb\tb\tNN\t_\t_\t3\tk2\t_\t_\n3\tc\tc\tVM\t_\tPronType=Dem\t0\tmain\t_\tChunkId=X\n\n"
    (tmp_path / "c.conllu").write_text(text, encoding="utf-8")
    return str(tmp_path / "c.conllu")


def test_each_filter_and_precedence(spark, tmp_path):
    got = {r["sent_id"]: (r["stage"], r["reason"]) for r in cascade.classify(read_conllu(spark, corpus(tmp_path))).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "pass": None, "question": 1, "negative": 2, "ghost": 3, "crossing": 4, "noroot": 5, "nominal": 5, "punct": 6, "single": 7, "both": 1}
    assert got["nominal"][1] == "Bad Root: Root POS is 'NN', expected VERB/AUX/VM/VAUX"
    assert got["single"][1] == "Fewer than 2 preverbal phrases"


def test_features_and_variants(spark, tmp_path):
    passed = cascade.classify(read_conllu(spark, corpus(tmp_path))).where("stage is null")
    f = cascade.passed_features(passed).first()
    assert (f["Phrase_Count"], f["Sentence_Length"], f["Deprel_Tags"]) == (3, 5, ["k1", "k2", "vmod"])
    rows = variants.labelled(variants.generate(passed, None)).orderBy("v").collect()
    assert [r["perm"] for r in rows] == [[0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]
    assert [r["ML_Label"] for r in rows] == [1, 0, 1, 0, 1]
    assert rows[0]["Variant_Sentence"] == "राम कल घर जाता है"
    assert variants.generate(passed, ["k1\tk2"]).count() == 0


def test_serialise_round_trip(spark, tmp_path):
    path = corpus(tmp_path)
    lines = {x for r in read_conllu(spark, path).select(serialise().alias("s")).collect() for x in r["s"].split("\n")}
    assert lines == {x for x in open(path, encoding="utf-8").read().split("\n") if x and x[0] != "#"}


def test_entry_imports_without_the_training_data_package():
    import __spark_entry__

    assert "filter_passed" in __spark_entry__.queries() and "filter_passed" in __spark_entry__.oracle_sql()


def test_orders_in_arrays_and_in_batches_agree(spark, tmp_path, monkeypatch):
    passed = cascade.classify(read_conllu(spark, corpus(tmp_path))).where("stage is null")
    native = variants.generate(passed, ["k1\tk2", "k2\tvmod", "vmod\tk1"], max_variants=9).collect()
    monkeypatch.setattr(variants, "NATIVE", 1)
    assert native and variants.generate(passed, ["k1\tk2", "k2\tvmod", "vmod\tk1"], max_variants=9).collect() == native
    sampled = variants._orders(["k1"] * 10, None, 42, "s", 99)
    assert len(sampled) == 99 and list(range(10)) not in sampled


def test_dependency_length_by_hand(spark, tmp_path):
    from vakya.operators import scorers

    passed = cascade.classify(read_conllu(spark, corpus(tmp_path))).where("stage is null")
    r = scorers.dependency_length(variants.labelled(variants.generate(passed, None))).orderBy("v").first()
    assert r["Ref_Features"] == [3, 0, 1, 1, 1] and r["Var_Features"] == [3, 0, 1, 1, 1] and r["Delta_DL"] == 0
