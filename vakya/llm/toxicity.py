"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary
labelled text. A text is cut into short word-aligned windows; each window is
compressed under both dictionaries, and the histogram of length differences
feeds a logistic calibration. Whole texts are scored, never prefixes.

Dictionaries that are trained on all text of a class tell little here: most of toxic
text is ordinary prose. So a class's own part is trained on its significant windows only.
Sizes and segments were chosen by cross-validation within the training rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample for training, per class.
SAMPLE_PER_CLASS = 2500
#: Bytes of the background and of a class's own part, and the most samples that each is trained on.
BASE_BYTES, PART_BYTES = 16_000, 4_000
BASE_SAMPLES, PART_SAMPLES = 40_000, 20_000
#: Bytes of the segments that the trainer picks for each.
BASE_SEGMENT, PART_SEGMENT = 50, 48
#: Fewest texts of a class to train on: its halves take turns at dictionaries and calibration.
LEAST = 4
#: Windows are word-aligned; a longer word makes several.
WINDOW_CHARS = 16
#: What every window is compressed after; both dictionaries hold it, so its cost cancels out.
LEAD = b"~0123456789abcdefghijklmnop~"
#: What every window ends with: the library looks for no match in the last eight bytes.
TRAIL = b"~ponmlkjihgf~"
#: Keeps the last fragment of a dictionary apart from the trail.
GAP = b"\n#%$@!&*\n"
TOP = 12
CACHE = 200_000
#: Windows compressed in one call.
CALL = 4096


_WORD = re.compile(r"[^\W_]+")


def windows(text: str, size: int = WINDOW_CHARS) -> list[str]:
    """The words of a lower-cased text; those longer than ``size`` are cut into several windows."""
    out = []
    for w in _WORD.findall(text.lower()):
        if len(w) <= size:
            out.append(w)
        else:
            out += [w[i : i + size] for i in range(0, len(w), size)]
    return out


EDGE = len(LEAD) + len(TRAIL)


def _graded(saved: int, size: int) -> int:
    """Bytes saved, up to 6; above 6 if no more than a match is left of the window."""
    return 6 + min(TOP - 6, saved) if 2 < saved >= size - 4 else min(6, max(-TOP, saved))


class _Differences(dict):
    """Window -> graded saving of the toxic dictionary against the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.t, self.o = _compressor(toxic), _compressor(ordinary)

    def learn(self, words: set[str]) -> None:
        """Compress windows not met yet, many to a call."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(words)
        for at in range(0, len(new), CALL):
            part = new[at : at + CALL]
            parts = [LEAD + b" " + w.encode("utf-8", "replace") + b" " + TRAIL for w in part]
            t, o = (c.multi_compress_to_buffer(parts, threads=1) for c in (self.t, self.o))
            self.update((w, _graded(len(y) - len(x), len(p) - EDGE)) for w, p, x, y in zip(part, parts, t, o, strict=True))

    def histograms(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        for text in texts:
            parts = windows(text or "")
            self.learn(set(parts))
            yield np.bincount(np.fromiter(map(self.__getitem__, parts), np.int64, len(parts)) + TOP, minlength=2 * TOP + 1)


def _compressor(content: bytes):
    import zstandard as zs

    params = zs.ZstdCompressionParameters.from_level(
        3, format=zs.FORMAT_ZSTD1_MAGICLESS, strategy=zs.STRATEGY_GREEDY, min_match=4, window_log=15, hash_log=13, chain_log=13, search_log=4, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=d, compression_params=params)


def _features(hist: np.ndarray) -> np.ndarray:
    """Tails of a document's window-difference histogram: damped counts and rates."""
    n = max(1, int(hist.sum()))
    tails = hist[::-1].cumsum()[: TOP][::-1].astype(float)  # at least 1, 2, ... bytes saved
    low = hist[:TOP].sum()
    return np.concatenate([[1.0], np.log1p(tails), np.sqrt(tails / n) * 5, tails > 0, [math.sqrt(low / n) * 5, math.log1p(n)], np.log1p(tails[2:]) * math.log1p(n) / 8])


@dataclass
class ToxicityModel:
    """Dictionaries, feature scale and logistic weights; a few hundred kilobytes whatever the corpus."""

    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.0

    def scorer(self):
        if self.weights is None:
            return lambda texts: [self.prior for _ in texts]
        seen = _Differences(self.toxic, self.ordinary)

        def score(texts: Iterable[str | None]) -> list[float]:
            x = np.array([_features(h) for h in seen.histograms(texts)]).reshape(-1, len(self.mean))
            z = np.clip(((x - self.mean) / self.scale * self.weights).sum(1), -30, 30)  # row by row alike in any batch
            return (1.0 / (1.0 + np.exp(-z))).tolist()

        return score


def _words_held(texts: list[str]) -> Counter:
    """Number of texts with each window."""
    df: Counter = Counter()
    for t in texts:
        df.update(set(windows(t)))
    return df


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a dictionary that zstandard trains on the samples; the samples themselves where they are too few for it."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples, k=segment, d=6).as_bytes()[-size:]
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def _spread(rows: list, most: int) -> list:
    """All of the rows, or ``most`` of them at even distances."""
    return rows if len(rows) <= most else [rows[i * len(rows) // most] for i in range(most)]


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Train one dictionary per class.

    Both begin with a background that is trained on the prose of both classes, since
    toxic text is mostly ordinary prose. Then each class has a part trained on
    its own text alone, on those windows that it holds significantly more
    often than the other class.
    """
    a, b = _words_held(toxic), _words_held(ordinary)
    na, nb = len(toxic), len(ordinary)

    def part(texts: list[str], x: Counter, y: Counter, nx: int, ny: int) -> bytes:
        sure, lean = math.log(len(x) + 1) + 2, set()  # leaves out what stands among so many words by chance
        for w, k in x.items():
            e = (y.get(w, 0) + 0.5) * nx / (ny + 1)
            if k > 2 * e and k * math.log(k / e) - k + e > sure:
                lean.add(w)
        own = [w for t in texts for w in windows(t) if w in lean]
        return _trained([f" {w} ".encode() for w in _spread(own, PART_SAMPLES)], PART_BYTES, PART_SEGMENT) if own else b""

    prose = [w.encode() for t in [*ordinary, *toxic] for w in re.findall(r"(?s).{1,200}", t.lower())]
    common = _trained(_spread(prose, BASE_SAMPLES), BASE_BYTES, BASE_SEGMENT)
    return tuple(common + x + GAP + TRAIL + LEAD for x in (part(toxic, a, b, na, nb), part(ordinary, b, a, nb, na)))


def train(rows: list[tuple[str | None, int]], rate: float) -> ToxicityModel:
    """Train on (text, toxic) rows; ``rate`` is the share of toxic rows among all usable labels.

    With fewer than LEAST texts of a class the model scores every text at ``rate``.
    """
    toxic = sorted(t or "" for t, y in rows if y)
    ordinary = sorted(t or "" for t, y in rows if not y)
    if min(len(toxic), len(ordinary)) < LEAST:
        return ToxicityModel(prior=rate)
    return _fit(toxic, ordinary, rate)


def _fit(toxic: list[str], ordinary: list[str], rate: float) -> ToxicityModel:
    # Dictionaries come from one half and the calibration from the other, then
    # the halves change roles, so that the differences aren't those of seen text.
    X, y = [], []
    for half in (0, 1):
        seen = _Differences(*_dictionaries(toxic[half::2], ordinary[half::2]))
        for label, texts in ((1, toxic[1 - half :: 2]), (0, ordinary[1 - half :: 2])):
            X += [_features(h) for h in seen.histograms(texts)]
            y += [label] * len(texts)
    X, y = np.array(X), np.array(y, float)
    mean, scale = X.mean(0), X.std(0)
    mean[0], scale[scale < 1e-9] = 0.0, 1.0
    Z = (X - mean) / scale
    share = y.mean()
    rate = min(max(rate, 1e-4), 1 - 1e-4)
    sw = np.where(y > 0, rate / share, (1 - rate) / (1 - share))
    w = np.zeros(Z.shape[1])
    ridge = np.full(Z.shape[1], 1.0)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(Z @ w, -30, 30)))
        g = Z.T @ (sw * (p - y)) + ridge * w
        H = (Z * (sw * p * (1 - p))[:, None]).T @ Z + np.diag(ridge)
        step = np.linalg.solve(H, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(*_dictionaries(toxic, ordinary), mean, scale, w, rate)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Train on a bounded sample of labelled documents outside the held-out quarter.

    The sample is, per class, the ``per_class`` documents whose hashed id is
    smallest; whole texts are taken, one (the first in order) where rows repeat an
    id. Rows with a null id or null label are ignored; a document with several
    labels counts as toxic if one of them is.
    """
    from .queries import held_out

    lab = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
        .where("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
        .where(~held_out(F.col("_id")))
    )
    counts = {r["_y"]: r["n"] for r in lab.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    picked = [lab.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(sample, "_id").groupBy("_id").agg(F.min("text"), F.max("_y")).drop("_id").collect()
    positive = sum(n for y, n in counts.items() if y > 0)
    return train([(r[0], int(r[1] > 0)) for r in rows], positive / max(1, sum(counts.values())))


_LOADED: dict[int, object] = {}


def _scorer(model: ToxicityModel):
    """One scorer per worker process, whose windows and dictionaries later tasks use again."""
    key = hash((model.toxic, model.ordinary, model.prior, None if model.weights is None else model.weights.tobytes()))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = model.scorer()
    return _LOADED[key]


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add ``score`` (0 to 1) to (doc_id, text); null and empty texts have the score of no window.

    Keeps every row, repeated ones too; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f(t.as_py() for t in b.column(1)), pa.float64())], ["doc_id", "score"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
