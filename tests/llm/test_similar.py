"""Near copies against brute force over shingle sets."""

import random

import numpy as np

from vakya.llm import similar


def _docs(copies=60, templates=30):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(copies):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 260]))]
        texts.append(" ".join(base))
        for _ in range(2):
            other = list(base)
            for _ in range(rng.randrange(1, 1 + len(base) // 40 + 1)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    shared = [rng.choice(words) for _ in range(120)]
    texts += [" ".join(shared + [rng.choice(words) for _ in range(60)]) for _ in range(templates)]
    return list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "One"), (9005, "two")]


def _shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(docs):
    sets = [(i, _shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def test_components_match_brute_force(spark):
    docs = _docs()
    found = similar.similar_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == _brute(docs)


def test_blocks_find_what_rounds_leave(spark, monkeypatch):
    monkeypatch.setattr(similar, "ROUNDS", 1)
    monkeypatch.setattr(similar, "BLOCK", 16)
    docs = _docs(10, 40)
    found = similar.similar_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == _brute(docs)


def test_empty_table_repeats_and_null_ids(spark):
    schema = "doc_id long, text string, fp string"
    assert similar.similar_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", None), (2, "A b c d e f", None)]
    got = similar.similar_components(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1)]


def test_group_of_many_differing_copies(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(300)]
    docs = []
    for i in range(1000):
        own = list(base)
        for at in rng.sample(range(300), rng.randint(2, 5)):
            own[at] = rng.choice(words)
        docs.append((i, " ".join(own)))
    found = similar.similar_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == _brute(docs)


def test_parity_bits_lose_no_pair_whatever_its_keys():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n, np.uint64) for n in (1, 4, 31, 33, 130, 250, 1000)]
    for x in list(sets):
        for share in (0.05, 0.1, 0.2, 0.4):
            sets.append(np.concatenate([x[int(share * len(x)) :], rng.integers(0, 1 << 63, int(share * len(x) / 2), np.uint64)]))
    sets = [np.unique(x) for x in sets]
    apart = np.arange(len(sets))
    r, c = similar.possible_pairs(np.array([len(x) for x in sets]), [similar.parity_bits(x) for x in sets], 0.8, [apart])
    found = {tuple(sorted(p)) for p in zip(r.tolist(), c.tolist(), strict=True)}
    want = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))}
    assert want <= found and len(found) < len(sets) * len(sets) / 4


def test_block_pair_with_one_common_key(spark, monkeypatch):
    monkeypatch.setattr(similar, "FEW", 1)
    monkeypatch.setattr(similar, "BLOCK", 4)
    hashes = np.random.default_rng(9).integers(0, 1 << 63, (20, 100)).tolist()
    sets = spark.createDataFrame([(1, hashes[1]), (2, hashes[1][:95]), *[(i, hashes[i]) for i in range(3, 20)]], "doc_id long, hashes array<bigint>")
    groups = spark.createDataFrame([(7, i, i, 19) for i in range(1, 20)], "key long, a long, root long, n long")
    assert [tuple(r) for r in similar._block_pairs(groups, sets, 0.8).collect()] == [(2, 1)]


def test_short_texts_match_brute_force(spark):
    rng = random.Random(13)
    docs = []
    for i in range(400):
        n = rng.choice([8, 9, 12, 13, 14, 18, 25, 95, 98, 100, 104, 118])
        own = [f"s{i}x{k}" for k in range(n)]
        docs += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, *(f"y{i}x{k}" for k in range((n - 4) // 4))]))]
    found = similar.similar_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i - i % 2 for i, _ in docs}
