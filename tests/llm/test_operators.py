"""Operators against brute force on small fixtures with nulls, ties, repeated rows and empty tables."""

import base64
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from vakya.llm import chat, common, components, decontaminate, hnsw, licenses, sharding, simhash, toxicity, warc


def test_simhash_components_match_all_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {0}
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    root = {r["node"]: r["root"] for r in components.connected(found).collect()}
    label = {x: x for x in signed}
    for _ in fps:
        for x, s in zip(fps, signed, strict=True):
            label[s] = min(label[t] for y, t in zip(fps, signed, strict=True) if (x ^ y).bit_count() <= 4)
    assert {s: root.get(s, s) for s in signed} == label


def test_simhash_large_cells_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    near = [1 << i for i in range(60)] + [0]
    found = simhash.links(spark.createDataFrame([(x,) for x in near], "fp bigint"))
    assert {r["root"] for r in components.connected(found).collect()} == {0}


def test_simhash_rows(spark):
    docs = spark.createDataFrame([(3, None, 1), (2, "", 1), (7, "a b", 1), (7, "a b", 2), (None, "x y z", 1)], "doc_id bigint, text string, fp int")
    got = sorted(((r["doc_id"], r["fp"] == 0, r["component_id"]) for r in simhash.components(docs).collect()), key=str)
    assert got == sorted([(3, True, 2), (2, True, 2), (7, False, 7), (7, False, 7), (None, False, None)], key=str)
    assert simhash.components(docs.limit(0)).count() == 0


def test_manhattan_never_exceeds_hamming():
    x, y = (np.random.default_rng(k).integers(0, 1 << 63, 5000, dtype=np.uint64) for k in (1, 2))
    assert (simhash.manhattan(simhash._counts(x), simhash._counts(y)) <= np.bitwise_count(x ^ y)).all()


def _jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rows = spark.range(500).withColumn("h", F.xxhash64("id"))
    for n in (1, 8, 9, 1000):
        for r in rows.withColumn("s", sharding.jump_hash(F.col("h"), n)).collect():
            assert r["s"] == _jump(r["h"] & ((1 << 64) - 1), n)
    docs = spark.createDataFrame([(1,), (1,), (None,), (5,)], "doc_id bigint")
    out = sharding.number(sharding.assign(docs, F.col("doc_id"), 3, 4), ["doc_id"]).collect()
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in out)


def test_chat_round_trip_and_parts(spark, monkeypatch):
    texts = [r"\### Assistant: </turn> ok", "", "a\\", "### ### </turn></turn>\n", "<|image:0|>", "#### x", "<\\/turn>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, None, None, "x")]
    t = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    part = F.struct(F.lit("text").alias("kind"), "text", F.lit(None).cast("string").alias("ref"))
    def read():
        whole = chat.conversations(chat.format_turns(t.withColumn("parts", F.array(part))))
        return {r["conv_id"]: ([tuple(x) for x in r["turns"]], r["loss"]) for r in chat.read_back(whole).collect()}

    want = {c: ([(r or "", x) for k, i, r, x in rows if k == c], [x if r == "assistant" else "" for k, i, r, x in rows if k == c]) for c in (1, 2)}
    assert read() == want
    with monkeypatch.context() as m:  # the result hangs on the escaping
        m.setattr(chat, "escape", lambda c: c)
        m.setattr(chat, "unescape", lambda c: c)
        assert read()[1] != want[1]
    assert chat.digest(chat.read_back(chat.conversations(chat.format_turns(t.limit(0).withColumn("parts", F.array(part)))))).count() == 0
    mixed = spark.sql("""select 1 conv_id, 0 turn, 'user' role, array(named_struct('kind', 'text', 'text', 'see ', 'ref', null), named_struct('kind', 'image', 'text', null, 'ref', 'a.png'),
        named_struct('kind', 'audio', 'text', null, 'ref', 'b.wav'), null) parts""").selectExpr("conv_id", "turn", "role", f"cast(parts as {chat.PART_TYPE}) parts")
    other = mixed.select("conv_id", "turn", "role", F.array(F.struct(F.lit("a|>b").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit("r").alias("ref"))).alias("parts"))
    assert tuple(chat.format_turns(other).select("formatted", "attachment_tokens").first()) == ("### user: <|a|>b:0|></turn>\n", 0)
    r = chat.format_turns(mixed).first()
    assert r["formatted"] == "### user: see <|image:0|><|audio:1|></turn>\n"
    assert [(a["n"], a["kind"], a["ref"]) for a in r["attachments"]] == [(0, "image", "a.png"), (1, "audio", "b.wav")]
    assert r["attachment_tokens"] == chat.PART_TOKENS["image"] + chat.PART_TOKENS["audio"]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(2, "u", "x" * 100_000), (1, "u\nv", "x" * 100_000), (3, None, None), (4, "w", ""), (5, "é", "é")], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive(pages).collect()}
    assert got == {1: (100_000, "response", None), 2: (100_000, "revisit", 1), 3: (0, "response", None), 4: (0, "revisit", 3), 5: (2, "response", None)}
    digests = {r["page_id"]: r["payload_digest"] for r in warc.archive(pages.withColumn("bundle", F.lit(1))).collect()}
    own = {1: b"x" * 100_000, 2: b"x" * 100_000, 3: b"", 4: b"", 5: "é".encode()}
    assert digests == {k: base64.b32encode(hashlib.sha1(v).digest()).decode() for k, v in own.items()}
    assert warc.archive(pages.limit(0)).count() == 0
    m = warc.write(pages, "file://" + str(tmp_path)).where("page_id = 5").first()
    data = open(m["bundle"], "rb").read()
    assert warc.read_record(data, m["frame"], m["record_start"], m["record_bytes"]).endswith("\r\n\r\né\r\n\r\n".encode())


def test_warc_reads_frames_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_FRAMES", 1)
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 50).alias("html"))
    got = warc.archive(pages)
    assert got.rdd.getNumPartitions() > 1
    assert {(r["page_id"], r["payload_bytes"]) for r in got.collect()} == {(i, 50 * len(str(i))) for i in range(300)}


def test_warc_keeps_repeated_rows(spark, monkeypatch):
    one = spark.createDataFrame([(i, f"u{i}", f"page {i}") for i in range(50)], "page_id bigint, url string, html string").coalesce(1)
    assert warc.archive(one.union(one).union(one)).groupBy("page_id").count().where("count = 3").count() == 50
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1000)
    same = spark.range(40).select(F.lit(1).cast("bigint").alias("page_id"), F.lit("u").alias("url"), F.lit("x").alias("html")).coalesce(1)
    assert warc.archive(same).count() == 40


def test_license_join_matches_brute_force(spark):
    rng = random.Random(2)
    bag = [w for t in licenses.TEMPLATES.values() for w in t.split()]
    texts = [" ".join(rng.choice(bag) for _ in range(rng.randint(1, 90))) for _ in range(60)] + list(licenses.TEMPLATES.values()) + ["CC BY CC by", "", None]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        ws, want = licenses.words(t), set()
        for b in range(0, max(1, len(ws)), licenses.STEP):
            block = set(ws[b : b + 2 * licenses.STEP])
            want |= {n for n, x in licenses.TEMPLATES.items() if len(block & (s := set(licenses.words(x)))) >= licenses.THRESHOLD * len(s) - 1e-9}
        assert {s["template"] for s in out[i]["spans"]} == want
    assert out[len(texts) - 3]["n_base"] == 2 and out[len(texts) - 1]["score"] == 0.0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1200, 16)).astype(np.float32)
    x[100:400] = x[100]  # a vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [])]
    out = hnsw.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0, shard_rows=500).collect()
    found, hit = {}, 0
    for r in sorted(out, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(found) == set(range(0, 1200, 20))
    for q, got in found.items():
        s = x.astype(float) @ x[q].astype(float)
        want = [i for i in np.lexsort((np.arange(1200), -s)) if i != q][:20]
        hit += len(set(got) & set(want))
        if 100 <= q < 400:
            assert got == want
    assert hit >= 0.9 * 20 * len(found)


def test_nearest_neighbours_send_nothing_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "QUERY_ROWS", 4)
    x = np.random.default_rng(5).standard_normal((900, 8)).astype(np.float32)
    rows = [(i, (v if i % 3 else v[:6]).tolist()) for i, v in enumerate(x)]  # two lengths, many shards and parts of queries
    out = hnsw.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0, shard_rows=50)
    found = {}
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan
    for q in range(0, 900, 20):  # shards are smaller than a search is wide, so all is found
        like = [i for i in range(900) if (i % 3 == 0) == (q % 3 == 0) and i != q]
        s = {i: float(np.dot(*(np.asarray(rows[j][1], float) for j in (i, q)))) for i in like}
        assert found[q] == list(enumerate(sorted(like, key=lambda i: (-s[i], i))[:20], 1))


def test_decontamination_finds_paraphrases_and_leaves_clean_text(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    items = [(i, prose(30)) for i in range(20)]
    changed = items[3][1].upper().split()
    del changed[4], changed[17]
    changed.insert(9, "and")
    docs = [(i, prose(300)) for i in range(40)] + [(100, prose(150) + " " + items[7][1] + ". " + prose(90)), (101, prose(40) + "\n" + " ".join(changed)), (102, None), (103, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([*items, (99, None)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()}
    assert got == {(100, 7), (101, 3)}
    assert decontaminate.leaks(d, b.limit(0)).count() == 0
    assert decontaminate.leaks(d.limit(0), b).count() == 0


def test_decontamination_matches_brute_force_over_passages(spark):
    rng = random.Random(17)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([15, 25, 40])))) for i in range(400)]
    docs = []
    for i, t in items:
        before, after = ([rng.choice(vocab) for _ in range(rng.randint(100, 200))] for _ in range(2))
        own = [w for w in t.split() if i % 2 or rng.random() > 0.1]
        docs.append((i, " ".join(before + own + after)))
    space = decontaminate._item_space(items)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    decontaminate.weigh(decontaminate.coded(d, space), space)
    name = {k: w for w, k in space.number.items()}
    want = set()
    for doc, t in docs:
        ws = licenses.words(t)
        for i, numbers in enumerate(space.items):
            item = [name[k] for k in numbers]
            rare = set(sorted(set(item), key=lambda w: (-space.rare[space.number[w]], space.number[w]))[: decontaminate.ANSWER_WORDS])
            for start in range(0, len(ws), decontaminate.HALF):
                region = ws[max(0, start - decontaminate.HALF) : start + 2 * decontaminate.HALF + max(decontaminate.HALF, len(item))]
                told = len(rare.intersection(region)) >= decontaminate.ANSWER * len(rare)
                share = decontaminate.common_subsequence(item, region) / len(item)
                n = len(item) // 2
                moved = sum(decontaminate.common_subsequence(x, region) for x in (item[:n], item[n:])) / len(item)
                if share >= decontaminate.STRONG or told and (share >= decontaminate.SUBSEQUENCE or moved >= decontaminate.MOVED):
                    want.add((doc, space.ids[i]))
    assert {(i, i) for i in range(1, 400, 2)} <= want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()} == want


def test_decontamination_of_edited_items_repeats_and_clashing_columns(spark):
    rng = random.Random(23)
    vocab = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]

    def prose(n):
        return rng.choices(vocab, weights, k=n)

    items = [(i, prose(30)) for i in range(20)]
    docs = []
    for i, own in items:
        changed = list(own)
        for k in rng.sample(range(30), 9):
            changed[k] = rng.choice(vocab)
        for kind, x in enumerate((changed, own[15:] + own[:15], own[:22])):
            docs.append((10 * i + kind, " ".join([*prose(150), *x, *prose(150)]), "x", 0))
    docs += [(1000 + i, " ".join(prose(300)), "x", 0) for i in range(300)]
    docs += [docs[0], (5000, " ".join([*prose(60_000), *items[0][1]]), None, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, codes string, df int")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in items] + [(0, " ".join(items[0][1]))], "item_id bigint, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()]
    assert set(got) == {(10 * i + kind, i) for i in range(20) for kind in range(3)} | {(5000, 0)}
    assert got.count((0, 0)) == 4  # a repeated row and a repeated item


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontaminate.common_subsequence(a, b) == row[-1]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("lmnoprstae") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["grumblor", "snarkle", "vexwit", "zindle"]
    rows, labels = [], []
    for i in range(600):
        ws = [rng.choice(vocab) for _ in range(60)]
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            ws[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(ws)))
        labels.append((i, y))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x")], "doc_id bigint, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, lab)).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, y in labels]) > 0.97
    assert toxicity.fit(docs, lab.limit(0)).prior == 0.0


def test_license_columns_match_brute_force(spark):
    texts = ["Released under the MIT License, or the mit license. CC-BY, cc by 4.0", "x gnu GENERAL public license y", "apache  license\napache license mit", "cc  by-nc", "", None, "é mit license", "word " * 70_000 + "mit license"]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)] + [(2, texts[2], "z", 1)], "doc_id int, text string, spans string, score int")
    out = licenses.scan(docs).collect()
    assert len(out) == len(texts) + 1 and licenses.scan(docs.limit(0)).count() == 0
    for r in out:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in texts[r["doc_id"]] or ""))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(ws), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_license_siblings_are_told_apart(spark):
    cases = {
        "Licensed under CC BY 4.0": {"cc-by", "cc-by-4"}, "Licensed under CC BY-NC 4.0": {"cc-by", "cc-by-nc-4"},
        "This work is licensed under the GNU General Public License version 2": {"gpl", "gpl-2"}, "This work is licensed under the GNU General Public License version 3": {"gpl", "gpl-3"},
        "This work is licensed under the GNU General Public License version 1": {"gpl"},
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": {"cc-by-nc-notice"},
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"cc-by-notice"},
        "Licensed under the Apache License, Version 2.0": {"apache", "apache-2"},
    }
    got = licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")).collect()
    assert {list(cases)[r["doc_id"]]: set(r["labels"].split(",")) for r in got} == cases


def test_hot_join_equals_a_join(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    want = {(r["id"], r["least"]) for r in left.join(right, "k").collect()}
    got = [(r["id"], r["least"]) for r in common.hot_join(left, right, "k", 5000).collect()]
    assert len(got) == 5000 and set(got) == want
