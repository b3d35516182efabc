"""Token counts of byte-level BPE with a whole-token shortcut.

Offline, every vocabulary string that is one pre-token and whose own merging
ends in itself is proven to encode alone as one token. A text's pre-tokens in that set
count 1 by lookup; only the rest are merged.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .backtrack import Backtracker

#: The byte-level pre-tokeniser's published pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 200_000
LIMIT = 512


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b if b in shown else 256 + n))
        n += b not in shown
    return out


class Merger:
    """Merging by rank of a tokenizer file's merge list."""

    def __init__(self, raw: bytes):
        import regex

        spec = json.loads(raw)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = not spec["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are supported")
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in white space are not supported")
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.letters = byte_letters()
        self.find = regex.compile(PATTERN).findall
        self.vocabulary = model["vocab"]

    def parts(self, text: str) -> list[str]:
        out = [self.letters[b] for b in text.encode("utf-8", "replace")]
        get, none = self.rank.get, 1 << 60
        ranks = [get(p, none) for p in zip(out, out[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((out[i], out[i + 1]), none)
            if i:
                ranks[i - 1] = get((out[i - 1], out[i]), none)
        return out

    def tracker(self) -> Backtracker:
        """Numbers the tokens in merge order; each token's halves are its merge."""
        tokens = [*self.letters, *(a + b for a, b in self.rank)]
        number = {t: k for k, t in enumerate(tokens)}
        if len(number) != len(tokens):
            raise ValueError("two merges make the same token")
        pairs = {(number[a], number[b]): number[a + b] for a, b in self.rank}
        halves = [None] * 256 + [(number[a], number[b]) for a, b in self.rank]
        return Backtracker(tokens, halves, lambda a, b: pairs.get((a, b)))

    def prove(self) -> list[str]:
        """Vocabulary strings that are one pre-token each and merge into one token."""
        back = {c: b for b, c in enumerate(self.letters)}
        out = []
        for v in self.vocabulary:
            if not all(c in back for c in v):
                continue
            try:
                text = bytes(back[c] for c in v).decode()
            except UnicodeDecodeError:
                continue
            if self.find(text) == [text] and self.parts(text) == [v]:
                out.append(text)
        return out


class Counts(dict):
    """Pre-token -> number of tokens: proven ones from the start, merged ones as they come."""

    def __init__(self, merger: Merger, proven: list[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.merger, self.rest = merger, 0
        self.tracker = merger.tracker()
        self.spelled = {i: c for i, c in enumerate(merger.letters)}

    def __missing__(self, pre: str) -> int:
        # Longest matches are a merge's outcome where all neighbours fit; else it is carried out.
        found = self.tracker.greedy(pre.encode("utf-8", "replace").decode("latin-1").translate(self.spelled))
        n = len(found) if found is not None else len(self.merger.parts(pre)) if len(pre) < 64 else heap_count(self.merger, pre)
        if self.rest < CACHE and len(pre) < 64:
            self[pre] = n
            self.rest += 1
        return n

    def count(self, text: str) -> int:
        m = self.merger
        pieces = m.cut(text) if m.cut else [text]
        return sum(sum(map(self.__getitem__, m.find(p))) for p in pieces) + len(pieces) - 1


def heap_count(m: Merger, pre: str) -> int:
    """Merging of a long pre-token with a heap over linked parts, in n log n."""
    import heapq

    part = [m.letters[b] for b in pre.encode("utf-8", "replace")]
    n = len(part)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := m.rank.get((part[i], part[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if part[i] != a or j >= n or part[j] != b:
            continue
        part[i], part[j] = a + b, ""
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        left -= 1
        for x, y in ((prv[i], i), (i, nxt[i])):
            if x >= 0 and y < n and (r := m.rank.get((part[x], part[y]))) is not None:
                heapq.heappush(heap, (r, x, part[x], part[y]))
    return left


_LOADED: dict[str, Counts] = {}


def load(raw: bytes, proven: list[str] | None = None) -> Counts:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _LOADED:
        m = Merger(raw)
        _LOADED[key] = Counts(m, m.prove() if proven is None else proven)
    return _LOADED[key]


def count_documents(docs: DataFrame, raw: bytes, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; a null text is empty.

    The proof runs once, on the driver; its list is bounded by the vocabulary.
    """
    proven = load(raw).merger.prove()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = load(raw, proven)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [c.count(t) for t in texts]
            size = [len(t.encode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
