"""SentencePiece BPE encoding by backtracking, and decoding.

The vocabulary is read from the model file; text is never merged pair by pair.
For every word an Aho-Corasick automaton finds all pieces; the longest match at
a position is tried first, accepted if it is compatible with the piece before
(their concatenation merges back into exactly these two), shortened otherwise,
and positions from which no encoding goes on are cleared in a bit field.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .backtrack import Backtracker

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: Words of a generation remembered per worker; when it's full, the generation before it is forgotten.
CACHE = 250_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            byte = data[i]
            i += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[i : i + size]
            i += size


def merge(parts: list[str], score: dict[str, float]) -> list[str]:
    """Merging by score down to two parts, or as far as it goes; for vocabulary strings only."""
    while len(parts) > 2:
        best = max(((score[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in score), default=None)
        if best is None:
            break
        i = -best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class PieceModel:
    """Vocabulary of a merge-type model with identity normalisation and byte fallback."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        score: dict[str, float] = {}
        self.dummy_prefix, self.byte_id, self.unknown, self.end = True, {}, 0, 2
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                text, kind = f[1].decode(), f.get(3, _NORMAL)
                k = len(self.pieces)
                self.pieces.append(text)
                self.kinds.append(kind)
                if kind == _NORMAL:
                    score[text] = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
                elif kind == _BYTE:
                    self.byte_id[int(text[3:5], 16)] = k
                elif kind == _UNKNOWN:
                    self.unknown = k
                elif kind != _CONTROL:
                    raise ValueError("user-defined and unused pieces are not supported")
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2) or f.get(4, 1):
                    raise ValueError("only identity normalisation that keeps white space is supported")
                self.dummy_prefix = bool(f.get(3, 1))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in score):
            raise ValueError("pieces that go on over a space are not supported")
        if len(self.byte_id) != 256:
            raise ValueError("byte fallback is needed")
        self.end = self.pieces.index("</s>")
        self._build(score, {p: k for k, p in enumerate(self.pieces) if self.kinds[k] == _NORMAL})
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self._class = re.escape("".join(c for c in score if len(c) == 1))
        self.unmergeable = [c for c in "\n\t\r" if c not in score]
        cuts = re.escape("".join(self.unmergeable))
        self.split = re.compile(f"[{cuts}]|{SPACE}*[^{SPACE}{cuts}]+|{SPACE}+" if cuts else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def _build(self, score: dict[str, float], ids: dict[str, int]) -> None:
        """Number the pieces in merge order, single characters first; find the last merge of each.

        Pieces of several spaces may share one score below all others: their
        merges come last and from the left, so they are put together afterwards.
        """
        runs = {p for p in score if len(p) > 1 and not p.strip(SPACE)}
        rest = {p: x for p, x in score.items() if p not in runs}
        merged = [x for p, x in rest.items() if len(p) > 1]
        if len(set(merged)) != len(merged) or len({score[p] for p in runs}) > 1 or any(score[p] >= min(merged, default=0) for p in runs):
            raise ValueError("other pieces of equal score are not supported")
        if any(p.startswith(SPACE * 2) for p in rest):
            raise ValueError("pieces of several spaces and more are not supported")
        score = rest
        tokens = sorted(score, key=lambda p: (len(p) > 1, -score[p]))
        number = {p: k for k, p in enumerate(tokens)}
        self.runs = {1: number.get(SPACE, -1)} | {len(p): len(tokens) + i for i, p in enumerate(sorted(runs))}
        self.score = score

        def join(a: int, b: int) -> int | None:
            return number.get(tokens[a] + tokens[b])

        def last(p: str) -> tuple[int, int] | None:
            """The two parts before the last merge; None for a piece that merging never reaches."""
            parts = merge(list(p), score)
            return (number[parts[0]], number[parts[1]]) if len(parts) == 2 else None

        self.tracker = Backtracker(tokens, [last(p) if len(p) > 1 else None for p in tokens], join)
        self.ids = [ids[p] for p in [*tokens, *sorted(runs)]]
        self.shown = [str(k) for k in range(len(self.pieces))]
        self.spaced = [p.replace(SPACE, " ") for p in self.pieces]
        #: Ids from here on are ordinary pieces.
        self.ordinary = 1 + max((k for k, kind in enumerate(self.kinds) if kind != _NORMAL), default=-1)

    def _numbers(self, word: str) -> list[int] | None:
        out = self.tracker.encode(word)
        if out is not None and word.startswith(SPACE * 2):
            m, one, sizes = 0, self.runs[1], []
            while m < len(out) and out[m] == one:
                m += 1
                sizes.append(1)
                while len(sizes) > 1 and sizes[-2] + sizes[-1] in self.runs:
                    sizes[-2:] = [sizes[-2] + sizes[-1]]
            out = [self.runs[x] for x in sizes] + out[m:]
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of a stretch of text; characters outside the vocabulary become byte pieces."""
        out = self._numbers(word)
        if out is not None:
            return [self.ids[k] for k in out]
        ids: list[int] = []
        for part in re.findall("[{0}]+|[^{0}]".format(self._class), word):
            found = self._numbers(part)
            ids += [self.ids[k] for k in found] if found is not None else [self.byte_id[x] for x in part.encode("utf-8", "replace")]
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a stretch that the newer generation of words doesn't hold."""
        out = self.older.get(word)
        if out is None:
            out = tuple(self.encode_word(word))
        if len(self.words) >= CACHE:
            self.older = self.words
            self.words = {}
        if len(word) < 64:
            self.words[word] = out
        return out

    def _surface(self, ids: list[int]) -> str:
        """Spaces restored and byte runs decoded; a malformed byte becomes U+FFFD."""
        out, run = [], bytearray()
        for k in ids:
            kind = self.kinds[k]
            if kind == _BYTE:
                run.append(int(self.pieces[k][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if kind == _UNKNOWN:
                out.append(" ⁇ ")
            elif kind == _NORMAL:
                out.append(self.pieces[k].replace(SPACE, " "))
        return "".join(out) + run.decode("utf-8", "replace")

    def encode(self, text: str, end: bool = True) -> list[int]:
        """No piece goes on over the cuts between stretches: before a run of spaces, and around unmergeable characters."""
        ids: list[int] = []
        if text:
            more, word = ids.extend, self._word
            for w in self.split((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)):
                more(self.words.get(w) or word(w))
        if end:
            ids.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding put in front is dropped."""
        shown = ids[:-1] if ids and ids[-1] == self.end else ids
        if shown and min(shown) >= self.ordinary:
            out = "".join(map(self.spaced.__getitem__, shown))
        else:
            shown = [k for k in shown if self.kinds[k] != _CONTROL]
            out = self._surface(shown)
        starts = bool(shown) and self.kinds[shown[0]] == _NORMAL and out.startswith(" ")
        return out[1:] if self.dummy_prefix and starts else out

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids with the end id, SHA-256 of the ids as text, SHA-256 of the text that they decode to."""
        ids = self.encode(text or "")
        sha = hashlib.sha256
        return len(ids), sha(" ".join(map(self.shown.__getitem__, ids)).encode()).hexdigest(), sha(self.decode(ids).encode("utf-8", "replace")).hexdigest()


_LOADED: dict[str, PieceModel] = {}


def load(raw: bytes) -> PieceModel:
    """One model per worker process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = PieceModel(raw)
    return _LOADED[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, raw: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(raw)
        for b in batches:
            rows = [m.digests(t.as_py()) for t in b.column(1)]
            n, i, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, raw: bytes) -> DataFrame:
    """doc_id, ids and the decoded text of every whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(raw)
        for b in batches:
            ids = [m.encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"]
            )

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
