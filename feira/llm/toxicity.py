"""Toxicity as ordinal severity: a cumulative-link (proportional odds) model.

P(grade >= k) = sigmoid(w.x - theta_k) for the thresholds theta_1 <= theta_2
<= ...; all thresholds share the weights w. The grades are those of the data
(0 to any number; one threshold for each grade above 0 that occurs or is
exceeded); binary labels are two grades and so give one threshold, and
expected severity is then P(toxic). x holds one entry per distinct
feature word of the text: present or not, so the length of a text neither
dilutes nor amplifies a word. Expected severity = sum over k of P(grade >= k).

Features: words (lower-cased runs of letters), their beginnings of PREFIX and
their ends of SUFFIX letters, so that inflected forms count together. They are
counted per grade over the labelled documents; kept are the FEATURES with the
highest signed chi-square that are in at least MIN_DOCS labelled texts, are
more frequent in graded texts than chance (at least MIN_CHI2) and stand in at
least MIN_DOCS different contexts (neighbouring words) there: many copies of
one text are one piece of evidence. That is a bounded table, which is
broadcast. Only features that raise severity are used: what is absent from
the model cannot flag a clean text.

The model is fitted by projected gradient descent with an L1 penalty on a
bounded sample of labelled texts (the SAMPLE labels with the lowest hash, a
documented bound); feature counts use the same labelled texts. Every document
is scored over its whole text.

Defined cases: null, empty and wordless texts have no features (severity: the
intercept); duplicate labels of one id count with their highest grade; labels
without a document, null grades and null ids are ignored; without any graded
label every severity is 0; without labels at all too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm import _text as T
from feira.llm._ship import map_arrow

SAMPLE = 20_000
FEATURES = 4096
PREFIX = range(3, 8)
SUFFIX = range(4, 7)
MIN_DOCS = 8
MIN_CHI2 = 12.0
L1 = 0.1
STEPS = 500
RATE = 0.1
REJECT = 0.5


@dataclass
class Ordinal:
    """Fitted model: feature words, weights, thresholds (ascending)."""

    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, one row per entry of z."""
        return 1 / (1 + np.exp(-(z[:, None] - self.thresholds[None, :])))


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text index, word code) of every run of letters, and the distinct words."""
    clean = pc.replace_substring_regex(pc.utf8_lower(T.plain(texts)), r"[^\pL]+", " ")
    lists = pc.ascii_split_whitespace(clean)
    flat = lists.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    real = pc.not_equal(flat, "")
    enc = flat.filter(real).dictionary_encode()
    return (text[real.to_numpy(zero_copy_only=False)], enc.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            enc.dictionary.to_pylist())


def features_of(word: str) -> list[str]:
    """=word, ^beginning, end$."""
    n = len(word)
    return ["=" + word, *["^" + word[:k] for k in PREFIX if k < n], *[word[n - k:] + "$" for k in SUFFIX if k < n]]


def _expand(words: list[str], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """CSR (starts, feature ids) of the known features of each word."""
    ids: list[int] = []
    starts = np.zeros(len(words) + 1, np.int64)
    get = index.get
    for i, word in enumerate(words):
        for f in features_of(word):
            k = get(f)
            if k is not None:
                ids.append(k)
        starts[i + 1] = len(ids)
    return starts, np.asarray(ids, np.int64)


def _spread(code: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``code``, feature) for every feature of every word in ``code``."""
    n = starts[code + 1] - starts[code] if len(code) else np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(code)), n)
    if not len(at):
        return at, np.zeros(0, np.int64)
    within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, ids[starts[code[at]] + within]


def _hits(texts: pa.Array, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature), each pair once, by text."""
    text, code, words = _letters(texts)
    return _pairs_of(text, code, *_expand(words, index), index)


def _pairs_of(text, code, starts, ids, index) -> tuple[np.ndarray, np.ndarray]:
    at, feature = _spread(code, starts, ids)
    width = len(index) + 1
    pair = np.unique(text[at] * width + feature)
    return pair // width, pair % width


def labelled(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(t, grade) of the sampled labels; ``grades``: (doc_id, grade)."""
    best = (grades.filter("doc_id IS NOT NULL AND grade IS NOT NULL")
            .groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade")))
    some = best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented bound
    return (docs.select(F.col("doc_id"), F.col("text").alias("t"))
            .join(F.broadcast(some), "doc_id").select("t", "grade"))


def choose_features(texts: DataFrame) -> list[str]:
    """The features of the model, from (t, grade)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "t"):
                text, code, words = _letters(part.column("t"))
                names: dict[str, int] = {}
                for word in words:
                    for f in features_of(word):
                        names.setdefault(f, len(names))
                n = len(names) + 1
                once = np.unique(text * (len(words) + 1) + code)
                text, code = once // (len(words) + 1), once % (len(words) + 1)
                at, feature = _spread(code, *_expand(words, names))
                pair = np.unique(text[at] * n + feature)
                positive = (part.column("grade").to_numpy(zero_copy_only=False) > 0)[pair // n]
                hit = np.bincount(pair[positive] % n, minlength=n)[:n - 1]
                miss = np.bincount(pair[~positive] % n, minlength=n)[:n - 1]
                yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(hit.astype(np.int64)),
                                                  pa.array(miss.astype(np.int64))], ["word", "hit", "miss"])

    both = texts.agg(F.count_if(F.col("grade") > 0).alias("p"), F.count_if(F.col("grade") <= 0).alias("q")).first()
    if not both["p"]:
        return []
    p, q = float(both["p"]), float(both["q"])
    n = p + q
    c = (map_arrow(texts, count, "word string, hit long, miss long").groupBy("word")
         .agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss")).filter(F.col("hit") >= MIN_DOCS))
    excess = F.col("hit") * F.lit(q) - F.col("miss") * F.lit(p)
    df = F.col("hit") + F.col("miss")
    chi2 = n * excess * excess / F.greatest(df * (n - df) * p * q, F.lit(1e-9))
    best = c.filter(excess > 0).withColumn("chi2", chi2).filter(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "word")
    candidates = [r["word"] for r in best.select("word").limit(4 * FEATURES).collect()]  # a bounded model
    index = {w: i for i, w in enumerate(candidates)}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "t"):
                text, code, words = _letters(part.column("t"))
                h = T.hash_strings(words)[code] if len(code) else np.zeros(0, np.uint64)
                same = text[1:] == text[:-1]
                near = np.zeros(len(code), np.uint64)
                near[1:] += np.where(same, h[:-1] * np.uint64(3), np.uint64(0))
                near[:-1] += np.where(same, h[1:], np.uint64(0))
                at, feature = _spread(code, *_expand(words, index))
                pair = np.unique(np.column_stack([feature.astype(np.uint64), T.mix(near)[at]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].astype(np.int64)), pa.array(T.signed(pair[:, 1].copy()))],
                                                 ["feature", "context"])

    seen = (map_arrow(texts.filter("grade > 0"), contexts, "feature long, context long").distinct()
            .groupBy("feature").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS).collect())
    return [candidates[i] for i in sorted(r["feature"] for r in seen)][:FEATURES]


def fit(texts: DataFrame) -> Ordinal:
    """Fit on (t, grade); the sample's feature lists (at most FEATURES per text) reach the driver."""
    words = choose_features(texts)
    if not words:
        return Ordinal()
    index = {w: i for i, w in enumerate(words)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "t"):
                text, code, names = _letters(part.column("t"))
                grade = np.maximum(part.column("grade").to_numpy(zero_copy_only=False), 0)
                text, feature = _pairs_of(text, code, *_expand(names, index), index)
                at = np.searchsorted(text, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32())),
                                                  pa.array(grade.astype(np.int32))], ["x", "grade"])

    # equal feature lists are one weighted row
    rows = (map_arrow(texts, encode, "x array<int>, grade int").groupBy("x", "grade").agg(F.count("*").alias("n"))
            .toPandas().sort_values(["grade", "n"], kind="stable"))
    return fit_rows(rows["x"].tolist(), rows["grade"].to_numpy(), rows["n"].to_numpy(float), words)


def fit_rows(x: list, grade: np.ndarray, n: np.ndarray, words: list[str]) -> Ordinal:
    """Projected gradient steps (moment scaled) on weighted rows of feature lists;
    weights stay at zero or above, thresholds in order."""
    top = int(grade.max())
    lens = np.array([len(v) for v in x])
    cols = np.concatenate([np.asarray(v, np.int64) for v in x]) if lens.sum() else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(x)), lens)
    levels = np.arange(1, top + 1)
    y = (grade[:, None] >= levels[None, :]).astype(float)
    total = n.sum()
    share = np.clip((n[:, None] * y).sum(0) / total, 1e-4, 1 - 1e-4)
    theta = np.maximum.accumulate(-np.log(share / (1 - share)))
    w = np.zeros(len(words))
    both = np.concatenate([w, theta])
    m, v = np.zeros(len(both)), np.zeros(len(both))
    for step in range(1, STEPS + 1):
        w, theta = both[:len(words)], both[len(words):]
        z = np.bincount(rows, w[cols], len(x))
        p = 1 / (1 + np.exp(-(z[:, None] - theta[None, :])))
        r = n[:, None] * (p - y)
        g = np.concatenate([np.bincount(cols, r.sum(1)[rows], len(w)) + L1, -r.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        both = both - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        both[:len(words)] = np.maximum(both[:len(words)], 0)
        both[len(words):] = np.maximum.accumulate(both[len(words):])
    w, theta = both[:len(words)], both[len(words):]
    return Ordinal(words, w, theta)


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, severity, p_toxic, grade) per row: expected severity,
    P(grade >= 1) and the most probable grade."""
    index = {w: i for i, w in enumerate(model.words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "t"):
                z = np.zeros(part.num_rows)
                if len(model.words):
                    text, feature = _hits(part.column("t"), index)
                    z = np.bincount(text, model.weights[feature], part.num_rows)
                if len(model.thresholds):
                    p = model.at_least(z)
                    cells = -np.diff(np.column_stack([np.ones(len(z)), p, np.zeros(len(z))]), axis=1)
                    severity, toxic, grade = p.sum(1), p[:, 0], cells.argmax(1)
                else:
                    severity, toxic, grade = np.zeros(len(z)), np.zeros(len(z)), np.zeros(len(z), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(severity), pa.array(toxic), pa.array(grade.astype(np.int32))],
                    ["doc_id", "severity", "p_toxic", "grade"])

    ident = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), run,
                     f"doc_id {ident}, severity double, p_toxic double, grade int")


def toxic_flag(texts: pa.Array, model: Ordinal) -> np.ndarray:
    if not len(model.thresholds) or not len(model.words):
        return np.zeros(len(texts), bool)
    text, feature = _hits(texts, {w: i for i, w in enumerate(model.words)})
    return model.at_least(np.bincount(text, model.weights[feature], len(texts)))[:, 0] >= REJECT


def without_toxic(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """The rows whose P(grade >= 1) stays under REJECT, columns as they came.

    One pass without a shuffle: the rows go through the task that scores them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, text_col):
                yield part.filter(pa.array(~toxic_flag(part.column(text_col), model)))

    return map_arrow(docs, run, docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from binary labels: 0 or 1."""
    return labels.select("doc_id", (F.col("toxic") == 1).cast("int").alias("grade"))
