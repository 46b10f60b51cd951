"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier per bit, on hashed byte n-grams, predicts whether
the language's codeword has that bit.  Decoding sums, for each codeword, the logistic losses of its bits
weighted by how reliable each classifier was on the training rows, and takes the codeword of the least
loss; a second one nearly as near marks the prediction as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import joined
from .common import task
from .tokens import slices

#: Hashed n-grams of one, two and three bytes share so many features.
FEATURES = 4096
#: Most labelled rows per language that the classifiers are fitted on: the bound of what reaches the driver.
SAMPLE = 400
_ROUNDS, _RATE, _DECAY = 300, 6.0, 1e-4
_MARGIN = 0.2

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: square roots of the shares of its byte n-grams, of length one.  ASCII letters
    are lower-cased; other ASCII counts as space."""
    data, bounds = joined(texts)
    n = len(bounds) - 1
    b = _FOLD[data].astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(bounds)) * FEATURES
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(b))
    out = np.zeros(n * FEATURES)
    code = np.zeros(len(b), np.int64)
    for k in (1, 2, 3):
        m = len(b) - k + 1
        if m <= 0:
            break
        code = code[:m] * 256 + b[k - 1:]
        at = ((code * 0x9E3779B1 + k * 0x85EBCA6B) >> 7) % FEATURES
        out += np.bincount((doc[:m] + at)[left[:m] >= k], minlength=n * FEATURES)
    out = np.sqrt(out.reshape(n, FEATURES)).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1.  Up to 7 languages: every split of them once; beyond, the best of some random
    dense codes by the least distance of two rows."""
    if k <= 7:
        bits = np.arange(1, 1 << max(0, k - 1))
        return np.where((bits[None, :] >> np.arange(k)[:, None]) & 1, 1, -1).astype(np.int8)
    rng, length, best, far = np.random.default_rng(7), int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(200):
        c = np.where(rng.random((k, length)) < 0.5, 1, -1).astype(np.int8)
        d = (c[:, None, :] != c[None, :, :]).sum(2) + length * np.eye(k, dtype=int)
        use = (c.min(0) < 0) & (c.max(0) > 0)
        if use.all() and d.min() > far:
            best, far = c, int(d.min())
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each codeword for each row, per unit of weight."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :])
        return (loss * self.trust).sum(2) / max(1e-9, float(self.trust.sum()))


def in_fold(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4 (null id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of each language, taken by a hash of the id outside the held-out fold."""
    known = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter(F.col("d").isNotNull() & F.col("t").isNotNull() & F.col("l").isNotNull() & ~in_fold("d"))
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], codewords(0), np.zeros((FEATURES, 0)), np.zeros(0), np.zeros(0))
    chance = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, 1.2 * sample / counts[k])))])
    u = (F.xxhash64("d", F.lit(11)).bitwiseAND((1 << 30) - 1)) / float(1 << 30)
    rows = known.filter(u < F.element_at(chance, F.col("l")))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("d", F.lit(11)), "t"))).filter(F.col("r") <= sample)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("l"), pa.array([r.tobytes() for r in features(part.column("t")).astype(np.float16)], pa.binary())], names=["l", "x"])

    got = sorted((r["l"], bytes(r["x"])) for r in rows.select("t", "l").mapInArrow(task(run), "l string, x binary").collect())
    x = np.stack([np.frombuffer(b, np.float16) for _, b in got]).astype(np.float32)
    y = np.array([languages.index(name) for name, _ in got])
    code = codewords(len(languages))
    target = code[y].astype(np.float32)
    weight = (1.0 / np.bincount(y, minlength=len(languages)))[y][:, None]
    share = np.zeros_like(target)
    for s in (1, -1):
        side = target == s
        share += side * weight / np.maximum((side * weight).sum(0), 1e-9) / 2
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(_ROUNDS):
        g = -share * target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        vw = 0.9 * vw - _RATE * (x.T @ g + _DECAY * w)
        vb = 0.9 * vb - _RATE * g.sum(0)
        w, b = w + vw, b + vb
    wrong = (share * (target * (x @ w + b) <= 0)).sum(0)
    return Model(languages, code, w, b, np.maximum(1 - 2 * wrong, 0.01))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, ambiguous.

    Whole texts, row by row, without a shuffle; the model is of fixed size.  Text that is null or has no
    letter, or a model without a language: ``und`` with score 0.  score: the share of the chosen codeword
    in the exponentials of the negative losses of all.  Repeated rows get equal predictions; an empty
    table gives none; other columns are not read.
    """
    names = np.array([*model.languages, "und"], object)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                for a in range(0, part.num_rows, 256):
                    sub = part.slice(a, 256)
                    letters = pc.fill_null(pc.match_substring_regex(sub.column("t"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                    best = np.full(sub.num_rows, len(names) - 1)
                    score, close = np.zeros(sub.num_rows), np.zeros(sub.num_rows, bool)
                    if letters.any() and model.languages:
                        loss = model.losses(features(sub.column("t").filter(pa.array(letters))))
                        best[letters] = loss.argmin(1)
                        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
                        score[letters] = p.max(1) / p.sum(1)
                        if loss.shape[1] > 1:
                            two = np.partition(loss, 1, axis=1)
                            close[letters] = two[:, 1] - two[:, 0] < _MARGIN
                    yield pa.RecordBatch.from_arrays([sub.column("d"), sub.column("held_out"), pa.array(names[best], pa.string()), pa.array(score), pa.array(close)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    d = docs.select(F.col(doc_id).cast("long").alias("d"), in_fold(doc_id).alias("held_out"), F.col(text).alias("t"))
    return d.mapInArrow(task(run), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
