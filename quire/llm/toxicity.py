"""Toxic passages by maximum-scoring segments.

Tokens (runs of letters, lower-cased), and the first STEMS letters of longer ones, get log-odds between the classes under an informative Dirichlet prior, whose
shape is flat plus the pooled counts; tokens whose log-odds aren't significant get the pooled rest's. A small drift per token
keeps unrelated passages apart. A token scores as itself where it is significant, else as its longest such stem. A linear-time scan finds all maximal segments of a document; extreme-value theory
(Karlin and Altschul) gives the score that chance reaches in a clean text of that length, and the excess of every
significant segment is summed. A logistic curve in that sum makes it a probability.

The model is learned from a bounded sample of labelled rows: about SAMPLE a class, chosen by a hash of doc_id among
those that may be learned from. All significant tokens and stems are kept and broadcast: each is in several rows of that sample.

Defined cases: null texts and texts without tokens have no passage and get the curve's lowest value; null doc_ids and
null labels are never learned from; a doc_id with several labels counts once for each; with one class or none to
learn from, every score is that class's share (0 if none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import sliced_batches, stored, table

SAMPLE = 12_000
PRIOR = 500.0
FLAT = 0.5
Z_LEAST = 3.0
DRIFT = 0.05
STEMS = (7, 6, 5, 4)
E_MOST = 1.0
BATCH_ROWS = 1000
WORDS_KEPT = 400_000
LONGEST_KEPT = 64
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """scores: of tokens; rest: of any other. a, b: the logistic curve. decay, scale: of the extreme-value law."""

    scores: dict[str, float]
    rest: float = 0.0
    decay: float = 1.0
    scale: float = 1.0
    a: float = 0.0
    b: float = 0.0
    share: float = 0.0
    words: dict = field(default_factory=dict, compare=False)


def held_out(docs: DataFrame) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def features(token: str) -> list[str]:
    """The token and its stems, longest first."""
    return [token, *(f"{token[:n]}*" for n in STEMS if len(token) > n)]


def token_score(token: str, model: Model) -> float:
    return next((model.scores[f] for f in features(token) if f in model.scores), model.rest)


class Words(dict):
    """The scores, as bytes of 32-bit floats, of the tokens of a word between white space."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        out = np.array([token_score(t, self.model) for t in LETTERS.findall(word.lower())], np.float32).tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = out
        return out


def token_scores(text: str, words: Words) -> np.ndarray:
    return np.frombuffer(b"".join(map(words.__getitem__, text.split())), np.float32)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), left to right, in linear time (Ruzzo and Tompa)."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    jumps = np.flatnonzero(np.diff(up) > 1)
    firsts, ends = up[np.concatenate(([0], jumps + 1))], up[np.concatenate((jumps, [len(up) - 1]))] + 1
    found: list[list] = []  # first, end, sum before, sum at its end, and the nearest one to the left that starts lower
    for first, end in zip(firsts.tolist(), ends.tolist(), strict=True):
        low, high = total[first], total[end]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([first, end, low, high, j])
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(f, e, h - lo) for f, e, lo, h, _ in found]


def excess(score: float, n: int, model: Model) -> float:
    """Natural log of how much rarer a segment is than once in a clean text of n tokens."""
    return model.decay * score - math.log(max(model.scale * n, 1e-300))


def significant(scores: np.ndarray, model: Model, e_most: float = E_MOST) -> list[tuple[int, int, float]]:
    """(first, end, excess) of segments that chance gives less than e_most times in a clean text of this length."""
    least = -math.log(e_most)
    return [(f, e, x) for f, e, s in segments(scores) if (x := excess(s, len(scores), model)) > least]


def probability(total: float, model: Model) -> float:
    if not model.scores:
        return model.share
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.a * math.log1p(total) + model.b))))


# Learning


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """text, toxic of the sample, and of each class its rows and the part of them that is taken."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(own))
    known = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    parts = {k: (n, min(1.0, sample / n)) for k, n in known.items()}
    chosen = F.lit(False)
    for k, (_, part) in parts.items():
        chosen = chosen | ((F.col("toxic") == k) & (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(part * (1 << 30))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(own.where(chosen)), "doc_id").select("text", "toxic"), parts


def token_counts(rows: DataFrame) -> DataFrame:
    """token, n0, n1: the clean and the toxic rows (text, toxic) that hold it. Rows, not occurrences: a word that
    one document repeats says no more than once."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_batches(batches, BATCH_ROWS):
            by = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[toxic].update({f for t in set(LETTERS.findall(text.lower())) for f in features(t)})
            tokens = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), *[pa.array([c[t] for t in tokens], pa.int64()) for c in by]], names=["token", "n0", "n1"])

    return rows.select("text", "toxic").mapInArrow(count, "token string, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_odds(counts: DataFrame, prior: float, z_least: float) -> tuple[dict[str, float], float]:
    """Log-odds of the significant tokens, and of all others together."""
    t = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    n0, n1 = t.n0 or 0, t.n1 or 0
    if not n0 or not n1:
        return {}, 0.0
    own = F.lit(FLAT) + F.lit(prior) * (F.col("n0") + F.col("n1")) / float(n0 + n1)
    side = lambda n, total: F.log((F.col(n) + own) / (total + prior - F.col(n) - own))
    scored = counts.withColumns({"s": side("n1", n1) - side("n0", n0), "z": (side("n1", n1) - side("n0", n0)) / F.sqrt(1 / (F.col("n1") + own) + 1 / (F.col("n0") + own))})
    top = scored.where(F.abs("z") >= z_least).collect()  # of a bounded sample of rows
    rest0, rest1 = n0 - sum(r.n0 for r in top), n1 - sum(r.n1 for r in top)
    rest = math.log((rest1 + 1) / (n1 + 1)) - math.log((rest0 + 1) / (n0 + 1))
    return {r.token: r.s for r in top}, rest


def score_counts(rows: DataFrame, model: Model) -> DataFrame:
    """value, n: how often tokens of rows (text) have each score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for batch in sliced_batches(batches, BATCH_ROWS):
            found = [token_scores(t, words) for t in batch.column(0).to_pylist()]
            v, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.float32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float32()), pa.array(n, pa.int64())], names=["value", "n"])

    return rows.select("text").mapInArrow(count, "value float, n long").groupBy("value").agg(F.sum("n").alias("n"))


def extreme_value(values: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """decay and scale of the law of maximal segments under scores drawn from clean text. decay solves
    E[exp(decay score)] = 1; scale is bounded by 1 start a token."""
    p = weights / max(1.0, weights.sum())
    if not len(values) or not (values > 0).any() or (p * values).sum() >= 0:
        return 1.0, 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * values, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
    return high, max(1e-6, p[values > 0].sum())


def curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method."""
    t = np.zeros(2)
    d = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ t, -30, 30)))
        g = d.T @ (w * (p - y)) + ridge * t
        h = (d * (w * p * (1 - p))[:, None]).T @ d + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        t -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, prior: float = PRIOR, drift: float = DRIFT) -> Model:
    rows, parts = sampled(docs, labels, sample)
    total = sum(n for n, _ in parts.values())
    share = parts.get(1, (0, 0))[0] / total if total else 0.0
    rows = stored(rows.dropDuplicates(["text", "toxic"]), "toxicity-sample")  # copies tell nothing new
    counts = stored(token_counts(rows), "toxicity-counts")
    odds, rest = log_odds(counts, prior, Z_LEAST)
    if not odds:
        return Model({}, share=share)
    odds, rest = {t: s - drift for t, s in odds.items()}, rest - drift
    drawn = score_counts(rows.where("toxic = 0"), Model(odds, rest)).collect()  # a row a score, one more than odds
    values, weights = np.array([r.value for r in drawn], float), np.array([r.n for r in drawn], float)
    decay, scale = extreme_value(values, weights)
    model = Model(odds, rest, decay, scale, share=share)
    found = totals(rows, model).select("toxic", "total").collect()  # two numbers for each row of the bounded sample
    x = np.log1p(np.array([r.total for r in found]))
    y = np.array([r.toxic for r in found], float)
    w = np.array([1 / parts[r.toxic][1] for r in found])
    a, b = curve(x, y, w / w.mean())
    return Model(odds, rest, decay, scale, a, b, share)


# Scoring


def with_segments(rows: DataFrame, model: Model, one, kind: pa.DataType, name: str, sql: str) -> DataFrame:
    """rows with a column made of (text, significant segments, words)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index("text")
    kept = [f"c{i}" for i in range(len(rows.columns))]
    schema = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(kept, rows.schema, strict=True))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = model.words.setdefault("", Words(model))
        for batch in sliced_batches(batches, BATCH_ROWS):
            out = []
            for text in batch.column(at).to_pylist():
                own = token_scores(text or "", words)
                out.append(one(text or "", significant(own, model) if model.scores and len(own) else [], model))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*kept, name])

    return rows.toDF(*kept).mapInArrow(score, f"{schema}, {name} {sql}").toDF(*rows.columns, name)


def totals(rows: DataFrame, model: Model) -> DataFrame:
    return with_segments(rows, model, lambda text, found, m: float(sum(x for _, _, x in found)), pa.float64(), "total", "double")


def scored(rows: DataFrame, model: Model) -> DataFrame:
    one = lambda text, found, m: probability(sum(x for _, _, x in found), m)
    return with_segments(rows, model, one, pa.float64(), "score", "double")


def passages(rows: DataFrame, model: Model) -> DataFrame:
    """rows (text and others) with passages: array<struct<start,end,excess>>, in code points, of every
    significant toxic passage."""

    def one(text: str, found: list[tuple[int, int, float]], m: Model) -> list[dict]:
        if not found:
            return []
        at = [(w.start() + t.start(), w.start() + t.end()) for w in re.finditer(r"\S+", text) for t in LETTERS.finditer(w[0])]
        return [{"start": at[f][0], "end": at[e - 1][1], "excess": float(x)} for f, e, x in found]

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("excess", pa.float64())]))
    return with_segments(rows, model, one, kind, "passages", "array<struct<start:bigint,end:bigint,excess:double>>")


def predictions(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(own, learned(own, labels, sample))
    return out.select("doc_id", held_out(out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
