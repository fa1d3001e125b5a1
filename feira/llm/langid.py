"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF weighted character n-grams (n = 1 to 3 over lower-cased
letters, everything else a blank), hashed to BUCKETS buckets, (1 + ln tf) *
idf, scaled to length 1. Document frequencies are counted over all training
documents. The weights are trained with follow-the-regularised-leader
(proximal, per coordinate, elastic net) on a bounded sample: about PER_LANGUAGE
distinct training texts of each language, those with the lowest hash, whole
texts; every language with training documents is learned. Every fifth
document of the sample is kept from training and sets the temperature that
divides the scores before the softmax. Every document is classified over its
whole text; only the text is an input of a prediction.

Defined cases: null text or text without a letter: ``und`` with score 0; no
training documents: ``und`` with score 0 for all; equal scores go to the
smaller language; the sample does not look at ids, so null and repeated ids
train like others, and copies of a text are one example; rows without a
language don't train.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm import _text as T
from feira.llm._ship import map_arrow

BITS = 14
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
PER_LANGUAGE = 2000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(buckets, 1 + ln tf) of each text; None if it has no letter."""
    low = pc.utf8_lower(T.plain(texts))
    size = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le"), np.uint32)
    letter = _is_letter()[points]
    c = np.where(letter, points, 32).astype(np.uint64)
    end = np.cumsum(size)
    coded = []
    for n in ORDERS:
        code = np.full(max(len(c) - n + 1, 0), n, np.uint64)
        real = np.zeros(len(code), bool)
        for k in range(n):
            code *= np.uint64(0x9E3779B97F4A7C15)
            code += c[k:len(code) + k]
            real |= letter[k:len(code) + k]
        code ^= code >> np.uint64(31)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        coded.append(np.where(real, (code >> np.uint64(64 - BITS)).astype(np.int64), BUCKETS))  # blanks only: no feature
    for i in range(len(size)):
        a, b = end[i] - size[i], end[i]
        if not letter[a:b].any():
            yield None
            continue
        tf = np.zeros(BUCKETS + 1, np.int64)
        for n, code in zip(ORDERS, coded):
            if b - a >= n:
                tf += np.bincount(code[a:b - n + 1], minlength=BUCKETS + 1)
        at = np.flatnonzero(tf[:BUCKETS])
        yield at, 1 + np.log(tf[at])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # [bucket, language]
    temperature: float = 1.0

    def scores(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return _scaled(at, tf, self.idf) @ self.weights[at]

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        return _softmax(z / self.temperature)


def _scaled(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = tf * idf[at]
    return x / max(math.sqrt(float(x @ x)), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray, n_languages: int) -> np.ndarray:
    """Weights after EPOCHS passes of FTRL-proximal over (buckets, tf, language)."""
    z, n = np.zeros((BUCKETS, n_languages)), np.zeros((BUCKETS, n_languages))

    def weights(z, n):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for at, tf, y in rows:
            x = _scaled(at, tf, idf)
            w = weights(z[at], n[at])
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    return weights(z, n)


def calibrate(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, on a fine grid."""
    best = (math.inf, 1.0)
    for t in np.exp(np.linspace(math.log(0.02), math.log(20), 200)):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        loss = float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())
        best = min(best, (loss, float(t)))
    return best[1]


def fit(rows: DataFrame) -> Model | None:
    """Train on (doc_id, t, lang), all rows labelled."""
    spark_rows = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one per language
    if not spark_rows:
        return None
    count = {r["lang"]: r["n"] for r in spark_rows}
    languages = sorted(count)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in T.slices(batch, "t"):
                for f in features(part.column("t")):
                    if f is not None:
                        df[f[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], ["bucket", "n"])

    df = np.zeros(BUCKETS)
    for r in (map_arrow(rows.select("t"), frequencies, "bucket long, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n")).collect()):  # at most BUCKETS rows
        df[r["bucket"]] = r["n"]
    idf = 1 + np.log((1 + sum(count.values())) / (1 + df))

    # the sample: distinct texts whose hash lies below a share of the range that gives about PER_LANGUAGE rows of each language
    share = F.create_map(*[F.lit(x) for lang, n in count.items() for x in (lang, min(1.0, PER_LANGUAGE / n))])
    place = F.pmod(F.xxhash64(F.lit("sample"), "t"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    code = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "t"):
                for i, f in enumerate(features(part.column("t"))):
                    if f is not None:
                        yield pa.RecordBatch.from_arrays(
                            [part.column("place").slice(i, 1), part.column("y").slice(i, 1),
                             pa.array([f[0].astype(np.int16)], pa.list_(pa.int16())),
                             pa.array([f[1].astype(np.float32)], pa.list_(pa.float32()))], ["place", "y", "at", "tf"])

    chosen = (rows.select("lang", "t", place.alias("place")).filter(F.col("place") < share[F.col("lang")])
              .dropDuplicates(["lang", "t"]))
    taken = (map_arrow(chosen.select("place", code[F.col("lang")].alias("y"), "t"), sampled,
                       "place double, y int, at array<short>, tf array<float>").toArrow())
    place_ = taken["place"].to_numpy()
    y = taken["y"].to_numpy()
    at = taken["at"].combine_chunks()
    start, flat = at.offsets.to_numpy(), at.values.to_numpy().astype(np.int64)
    tf = taken["tf"].combine_chunks().values.to_numpy().astype(float)
    if not len(y):
        return None
    rows_ = []
    spread = np.argsort(T.mix((place_ * (1 << 30)).astype(np.int64).view(np.uint64)) + y.astype(np.uint64), kind="stable")
    for i in spread:
        rows_.append((flat[start[i]:start[i + 1]], tf[start[i]:start[i + 1]], int(y[i])))
    held = rows_[::5] if len(rows_) >= 50 else []
    train = [r for k, r in enumerate(rows_) if not held or k % 5]
    model = Model(languages, idf, ftrl(train, idf, len(languages)))
    if held:
        model.temperature = calibrate(np.array([model.scores(a, t) for a, t, _ in held]), np.array([r[2] for r in held]))
    return model


def predict(rows: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of (doc_id, held_out, t)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in T.slices(batch, "t"):
                lang, score = [], []
                for f in features(part.column("t")):
                    if f is None or m is None:
                        lang.append("und")
                        score.append(0.0)
                        continue
                    p = m.probabilities(m.scores(*f))
                    best = int(p.argmax())
                    lang.append(m.languages[best])
                    score.append(float(p[best]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()),
                                                  pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    ident = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows.select("doc_id", "held_out", "t"), run,
                     f"doc_id {ident}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Train on labelled rows where ``held_out`` isn't true, predict all."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return predict(rows, fit(rows.filter("NOT held_out AND lang IS NOT NULL AND t IS NOT NULL").drop("held_out")))
