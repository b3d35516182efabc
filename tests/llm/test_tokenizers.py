"""Both tokenizer operators against their libraries."""

import hashlib
import random

import pytest

from vakya.llm import pieces, token_counts

P = pytest.importorskip("public_tokenizers")
PARTS = ["a", "the", " ", "  ", "\n", "é", "ß", "漢", "🙂", "▁", "</s>", "<0x0A>", "ing", "12", "\t", "'s", "<|endoftext|>", "…", "xx", "_", "\x00", "́", "र", "aaaa", "=="]


def texts():
    rng = random.Random(3)
    return ["", " ", "  a", "a" * 700, " " * 90, "x" * 30 + " " * 17 + "y", *("".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60))) for _ in range(1500))]


def test_pieces_match_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    raw = pieces.read_model(P.path("piece_bpe_32k.model"))
    m = pieces.load(raw)
    for t in texts():
        ids = sp.encode(t, add_eos=True)
        assert m.encode(t) == ids
        assert m.decode(ids) == sp.decode(ids)
        assert m.digests(t)[1] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a b", "z")], "doc_id bigint, text string, ids string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in pieces.encode_documents(docs, raw).collect()) == [(0, 3), (1, 1), (1, 1)]
    assert pieces.round_trip(docs.where("text = 'a b'"), raw).first()["decoded"] == "a b"
    assert pieces.encode_documents(docs.limit(0), raw).count() == 0


def test_fit_is_what_merging_gives():
    m = pieces.load(pieces.read_model(P.path("piece_bpe_32k.model")))
    rng, t = random.Random(5), m.tracker

    def merged(text):
        parts = list(text)
        while True:
            best = max(((m.score[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in m.score), default=None)
            if best is None:
                return parts
            parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]

    usable = [k for k, x in enumerate(t.tokens) if x in t.usable]
    for _ in range(3000):
        a, b = rng.choice(usable), rng.choice(usable)
        assert t.fit(a, b) == (merged(t.tokens[a] + t.tokens[b]) == [t.tokens[a], t.tokens[b]])


def test_counts_match_the_library(spark):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    raw = pieces.read_model(P.path("byte_bpe_50k.json"))
    c = token_counts.load(raw)
    for t in texts():
        assert c.count(t) == len(tok.encode(t, add_special_tokens=False).ids)
    docs = spark.createDataFrame([(1, None), (2, "word " * 600)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in token_counts.count_documents(docs, raw).collect()) == [(1, 0, 0, False), (2, 3000, 601, True)]
