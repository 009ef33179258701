"""Quality scores learned from preference pairs (Bradley-Terry).

Each text becomes a vector of surface features.  A labelled good text is
preferred to a labelled bad one; weights minimise the logistic loss of feature
differences, so a document's raw score is its Bradley-Terry log strength.  The
decision point is a quantile of the raw scores of the training texts, chosen
where it separates the labels best; the published score is a logistic curve of
the raw score laid so that the point falls on ``cut``.

Training fits on a bounded, documented sample: the ``sample`` labelled rows with
the smallest hash of their id (default 6,000), ``pairs`` opponents for each
good text.  Everything else reads all rows.

Defined cases: a null text is the empty text and gets a score; labels with a
null id or quality are not used; without both labels in the sample every score
is 0.5; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import map_texts, quoted

FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "stop", "other_punct", "space", "not_ascii",
            "distinct", "same_as_last", "top_word", "repeated_line", "line_words", "wordlike", "capital_words",
            "short_text", "word_spread")

_CLASS = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [_b < 128 and _c.isupper(), _b < 128 and _c.isdigit(), _c in "#*$%&|<>~^_=+@\\/{}[]`",
                  _c in ".,;:", _c in "!?\"'()-", _b in (9, 10, 11, 12, 13, 32), _b >= 192, 128 <= _b < 192]


def features(data: bytes) -> list[float]:
    """The vector of one whole text."""
    words = data.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256)
    upper, digit, symbol, stop, other, space, lead, cont = (hist @ _CLASS).tolist()
    chars = max(1.0, len(data) - cont)
    inked = max(1.0, chars - space)
    if not n:
        return [0.0] * (len(FEATURES) - 2) + [1.0, 0.0]
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.float64, n)
    again = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    wordlike = sum(c for w, c in seen.items() if w.rstrip(b".,;:!?").isalnum() or w[-1] >= 128)
    capital = sum(c for w, c in seen.items() if 65 <= w[0] <= 90)
    return [math.log1p(n), math.log(float(lengths.mean())), upper / inked, digit / inked, symbol / inked, stop / inked,
            other / inked, space / chars, lead / inked, math.log(len(seen)) / math.log(n + 1), again / n,
            max(seen.values()) / n, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
            wordlike / n, capital / n, 1.0 / (1 + n / 10), float(lengths.std()) / 10]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    point: float
    cut: float
    fitted: bool

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        z = np.clip(raw - self.point, -30, 30) + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, y: np.ndarray, cut: float, pairs: int = 8, ridge: float = 1e-3, rounds: int = 50) -> Model:
    """Weights by Newton steps on the pairwise logistic loss."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8) if len(x) else x
    good, bad = z[y == 1], z[y == 0]
    w = np.zeros(len(FEATURES))
    if not len(good) or not len(bad):
        return Model(mean, scale, w, 0.0, cut, False)
    # opponents in strides, so every bad text meets about as many good ones
    few = max(len(good), len(bad))
    i = np.arange(few * pairs)
    d = good[i % len(good)] - bad[(i + i // max(len(good), len(bad)) * 7) % len(bad)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / len(d) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    # the quantile of the scores that separates the labels best, both labels weighing the same
    order = np.argsort(raw, kind="stable")
    s, lab = raw[order], y[order]
    right = (np.cumsum(lab == 0) / len(bad)) + (1 - np.cumsum(lab == 1) / len(good))
    right[:-1][s[1:] == s[:-1]] = -1
    top = np.flatnonzero(right >= right.max() - 1e-12)
    k = int(top[len(top) // 2])
    above = s[k + 1] if k + 1 < len(s) else s[k] + 1.0
    return Model(mean, scale, w, float((s[k] + above) / 2), cut, True)


def held_out(id_col):
    """Rows that no label may be learned from: crc32 of the id's text, mod 5, is 0."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", cut: float = 0.3, sample: int = 6000, pairs: int = 8) -> Model:
    """Fit on at most ``sample`` labelled rows that are not held out."""
    usable = (labels.select(quoted(id_col).alias("__id"), quoted(label_col).cast("int").alias("__label"))
                    .filter(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & ~held_out(F.col("__id"))))
    chosen = usable.orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample)  # bounded: small enough to broadcast
    texts = docs.select(quoted(id_col).alias("__id"), quoted(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), "__id")
    got = featured(joined, "text", "__f", carry_text=False).orderBy("__id", "__label", "__f.x").limit(2 * sample)
    rows = got.select("__label", "__f.x").collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return fit_pairs(x, np.array([r["__label"] for r in rows], np.int64), cut, pairs)


def featured(df: DataFrame, text_col: str, result: str, carry_text: bool = True) -> DataFrame:
    def make():
        return lambda texts: {"x": [features(t.as_py()) for t in texts]}

    return map_texts(df, text_col, result, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))]), make,
                     carry_text)


def scored(docs: DataFrame, model: Model, text_col: str = "text", result: str = "quality",
           carry_text: bool = True) -> DataFrame:
    """``docs`` with the struct column ``result``: ``score`` (0 to 1) and
    ``predicted`` (1 if the score reaches the cut)."""
    fields = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        def work(texts):
            x = np.array([features(t.as_py()) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
            s = model.scores(x)
            return {"score": s, "predicted": (s >= model.cut).astype(np.int32)}
        return work

    return map_texts(docs, text_col, result, fields, make, carry_text)
