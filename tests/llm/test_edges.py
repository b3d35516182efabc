"""Queries over empty tables, and over nulls, repeated rows, very long texts and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from vakya.llm import queries

TEXTS = ["", None, "word " * 60_000, "x" * 70_000, "same text here twice", "same text here twice", "a"]
EXTRA = ["n", "key", "shard", "size", "fp", "_id", "_hot", "spans", "parts", "v", "slot", "score", "rank"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", None, 20), (4, TEXTS[4], "en", None, 20)]
    full, empty = (str(tmp_path_factory.mktemp(x)) for x in ("full", "empty"))
    tables = {
        "documents": spark.createDataFrame(rows, DOCS),
        "conversations": spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "b " * 30_000), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, None, None, None)], "conv_id bigint, turn bigint, role string, text string"),
        "embeddings": spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (20, [1.0])], "vec_id bigint, embedding array<float>"),
    }
    for name, df in tables.items():
        df.select("*", *[F.lit(f"{c}!").alias(c) for c in EXTRA]).coalesce(1).write.parquet(f"{full}/{name}.parquet")
        df.where("false").coalesce(1).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.mark.parametrize("name", ["op3_nearest", "op4_chat", "op5_license", "op7_simhash", "op8_sharding", "op9_token_counts"])
def test_empty_and_odd_tables(spark, folders, name):
    query = queries.queries()[name]
    full, empty = folders
    kept = query(spark, empty).collect()
    assert [r["conv_id"] for r in kept] == [-7] if name == "op4_chat" else kept == []
    rows = [r.asDict() for r in query(spark, full).collect()]
    if name == "op3_nearest":
        assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 1, 0.5), (0, 2, 1, 0.5)]
        return
    if name == "op4_chat":
        assert sorted((r["conv_id"] is None, r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in rows) == sorted(
            [(False, -7, 2, len(r"\### Assistant: </turn> ok")), (False, 1, 2, 60_000), (False, 2, 2, 0), (True, 0, 1, 0)])
        return
    assert sorted(r["doc_id"] for r in rows) == sorted([*range(len(TEXTS)), 4, 4])
    of = {r["doc_id"]: r for r in rows}
    if name == "op5_license":
        assert (of[1]["n_words"], of[2]["n_words"], of[3]["n_words"], of[4]["n_words"], of[2]["first_word"]) == (0, 60_000, 1, 4, None)
    elif name == "op7_simhash":
        assert of[0]["fingerprint"] == of[1]["fingerprint"] == "0" * 16 and of[1]["component_id"] == 0 and of[5]["component_id"] == 4
    elif name == "op8_sharding":
        assert (of[0]["size"], of[1]["size"], of[3]["size"], of[1]["text_crc32"]) == (1, 1, 70_001, 0)
        for shard in range(8):
            own = sorted(r["slot"] for r in rows if r["shard"] == shard)
            assert own == list(range(len(own)))
        assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    else:
        assert (of[0]["n_tokens"], of[1]["n_bytes"], of[2]["n_bytes"], of[2]["over_limit"], of[6]["n_tokens"]) == (0, 0, 300_000, True, 1)
