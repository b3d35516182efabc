"""Sinks read back, and a stream against the same files as a table."""

import json

from vakya.operators import cascade, lines
from vakya.sources import sinks
from vakya.sources.conllu import read_conllu
from vakya.streaming import sentences

from .test_cascade import corpus


def test_stream_gives_the_tables_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = corpus(tmp_path / "in")
    own = {r["sent_id"]: r["stage"] for r in cascade.classify(read_conllu(spark, path)).collect()}
    stream = sentences.classify_stream(sentences.read_conllu_stream(spark, str(tmp_path / "in")))
    for _ in range(2):  # the second run finds no new files
        sentences.write_sentences(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert {r["sent_id"]: r["stage"] for r in got} == own and len(got) == len(own)
        assert all((r["outcome"] == "passed") == (r["stage"] is None) for r in got)
    q = sentences.running_counts(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["n"] for r in spark.table("running").collect()) == len(own)


def test_sinks(spark, tmp_path):
    c = cascade.classify(read_conllu(spark, corpus(tmp_path)))
    sinks.write_conllu(c, str(tmp_path / "conllu"))
    again = cascade.classify(read_conllu(spark, str(tmp_path / "conllu")))
    assert {(r["sent_id"], r["stage"]) for r in again.collect()} == {(r["sent_id"], r["stage"]) for r in c.collect()}
    sinks.write_summary(c, str(tmp_path / "summary"))
    s = json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "summary"), wholetext=True).collect()))
    assert (s["total_input"], s["total_passed"], s["phrase_count_distribution"]) == (10, 1, {"3": 1})
    assert [x["rejected"] for x in s["filter_order"]] == [2, 1, 1, 1, 2, 1, 1]
    empty = json.loads(sinks.summary_json(c.limit(0)).first()["value"])
    assert empty["total_input"] == 0 and empty["phrase_count_distribution"] == {}
    sinks.write_csv(cascade.rendered(cascade.passed_features(c)), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["Sent_ID"] == "pass"
    rules = spark.createDataFrame([("CC", "S", "A", "B", 0.5), ("X", "A", "w", "-", 1.0)], "kind string, parent string, a string, b string, p double")
    sinks.write_rules(rules, str(tmp_path / "rules"))
    assert lines.parsed_rules(spark.read.text(str(tmp_path / "rules"))).count() == 2
    sinks.write_trees(spark.createDataFrame([("(S (A w))",), (None,)], "tree string"), str(tmp_path / "trees"))
    assert spark.read.text(str(tmp_path / "trees")).count() == 1
