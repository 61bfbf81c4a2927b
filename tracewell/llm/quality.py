"""A quality classifier from weak labels.

Overlapping heuristic labellers vote on each text; expectation-maximisation estimates their
accuracies from how often each pattern of votes occurs in the whole corpus; the patterns' posterior
labels train a logistic scorer over hashed features of a bounded sample, and it scores every text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among_lowest, materialise, table

#: Documents that the scorer is fitted on, at most; hashed dimensions.
TRAIN_DOCS, DIMENSIONS = 3000, 4096
GOOD, BAD, NONE = 1, 0, -1


def statistics(text: str) -> dict[str, float]:
    """Ratios that labellers and features look at. Each counts some text of ordinary kind along (ten
    words, twenty letters, four lines), so that a few words say little and many say what they are."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = np.frombuffer(text.encode(), np.uint8)
    count = np.bincount(raw, minlength=256)
    letters = int(count[65:91].sum() + count[97:123].sum() + count[0x80:].sum())
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    plain = int(sum(count[ord(c)] for c in ".,;:!?'\"-()"))
    return {
        "words": len(words),
        "upper": float(count[65:91].sum()) / (letters + 20),
        "symbols": (marks - plain) / chars,
        "shouts": float(count[ord("!")] + count[ord("?")]) / (n + 10),
        "digits": float(count[48:58].sum()) / chars,
        "distinct": (len(set(words)) + 5) / (len(words) + 10) ** 0.9,
        "top": (max(Counter(words).values(), default=0) + 1.5) / (len(words) + 10),
        "line_repeats": (len(lines) - len(set(lines))) / (len(lines) + 4),
        "length": (len(text) + 60) / (len(words) + 10),
        "plain_words": (sum(w.isalpha() or w[:-1].isalpha() for w in words) + 9.5) / (len(words) + 10),
        "squeezed": (len(zlib.compress(raw, 1)) + 100) / (raw.size + 200),
    }


#: What each labeller looks at, where it votes, and what. Every kind of junk is in the reach of several of
#: them, each by a measure of its own; a labeller that sees nothing of its kind abstains.
LABELLERS = {
    "symbols": (lambda x: x > 0.02, BAD),
    "plain_words": (lambda x: x < 0.75, BAD),
    "upper": (lambda x: x > 0.2, BAD),
    "shouts": (lambda x: x > 0.1, BAD),
    "top": (lambda x: x > 0.2, BAD),
    "distinct": (lambda x: x < 0.45, BAD),
    "line_repeats": (lambda x: x > 0.3, BAD),
    "squeezed": (lambda x: x < 0.25, BAD),
    "words": (lambda x: x == 0, BAD),
    "length": (lambda x: 3.5 < x < 8.5, GOOD),
}


def votes(s: dict[str, float]) -> tuple[int, ...]:
    """Each labeller's vote."""
    return tuple(vote if test(s[k]) else NONE for k, (test, vote) in LABELLERS.items())


def fit_labellers(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, np.ndarray]:
    """(share of good, P(vote | label) as [label, labeller, vote]) by expectation-maximisation.

    It starts from labellers that are mostly right; ten documents' worth of that start stay as a
    prior, so that a labeller without votes keeps it. Votes are in the order bad, good, none.
    """
    start = np.array([[0.4, 0.2, 0.4], [0.02, 0.58, 0.4]])
    v = np.array(list(patterns) or [()], int)
    n = np.array(list(patterns.values()) or [0], float)
    good, chance = 0.85, np.repeat(start[:, None], v.shape[1], axis=1)
    cast = np.stack([v == BAD, v == GOOD, v == NONE], axis=2).astype(float)
    for _ in range(rounds):
        p = posterior(v, good, chance)
        for label, w in ((0, n * (1 - p)), (1, n * p)):
            chance[label] = (np.tensordot(w, cast, 1) + 10 * start[label]) / (w.sum() + 10)
        good = float((n * p).sum() + 8.5) / (n.sum() + 10)
    return good, chance


def posterior(v: np.ndarray, good: float, chance: np.ndarray) -> np.ndarray:
    """P(good | votes), the labellers independent given the label."""
    at = np.where(v == NONE, 2, v)
    no, yes = (np.log(np.clip(chance[k][np.arange(v.shape[1]), at], 1e-6, 1)).sum(1) for k in (0, 1))
    return 1 / (1 + np.exp(np.clip(no + np.log(1 - good) - yes - np.log(good), -50, 50)))


def features(text: str, s: dict[str, float], size: int = DIMENSIONS) -> np.ndarray:
    """Hashed features: byte pairs by their share, statistics by their step, each in its dimension."""
    out = np.zeros(size, np.float32)
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if raw.size > 1:
        pair = ((raw[:-1] * 256 + raw[1:]) * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(pair % size, minlength=size)
        out /= np.linalg.norm(out)
    for name, x in s.items():
        step = int(np.searchsorted([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 5, 20, 100], x))
        out[zlib.crc32(f"{name}={step}".encode()) % size] += 1
    return out


def fit_scorer(x: np.ndarray, p: np.ndarray, updates: int = 900, rate: float = 0.1, reg: float = 1e-4) -> np.ndarray:
    """Weights and bias of a logistic scorer on soft labels, by Adagrad over mini-batches."""
    x = np.hstack([x, np.ones((x.shape[0], 1), np.float32)])
    w, g2 = np.zeros(x.shape[1], np.float32), np.full(x.shape[1], 1e-6, np.float32)
    r = np.random.default_rng(1)
    for _ in range(updates):
        part = r.integers(0, x.shape[0], 256)
        z = x[part] @ w
        g = x[part].T @ (1 / (1 + np.exp(-z)) - p[part]) / part.size + reg * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def _votes_text(s: dict[str, float]) -> str:
    return "".join("01-"[v] for v in votes(s))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_votes_text(statistics(t.as_py() or "")) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["votes"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, text) -> h, votes, and the places and values of the features that are not zero."""
    for b in batches:
        out = []
        for t in b.column(1):
            s = statistics(t.as_py())
            f = features(t.as_py(), s)
            at = np.flatnonzero(f).astype(np.int32)
            out.append((_votes_text(s), at.tobytes(), f[at].tobytes()))
        columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["h", "votes", "at", "value"])


def fit(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, dict]:
    """The scorer's weights, and the labellers' estimates.

    Vote patterns (at most 2 ** 10, counted over all documents) come to the driver, and the features
    of at most train_docs distinct texts: those with the smallest hash, so the choice does not depend
    on order, ids or partitions. An empty table gives weights that keep everything.
    """
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_vote, "votes string").groupBy("votes").count().collect()
    patterns = {tuple("01-".index(c) if c != "-" else NONE for c in r[0]): r[1] for r in counted}
    good, chance = fit_labellers(patterns)
    info = {"good": good, "chance": chance, "patterns": patterns}
    if not patterns:
        return np.r_[np.zeros(DIMENSIONS, np.float32), np.float32(1)], info
    probable = posterior(np.array(list(patterns)), good, chance)
    label = dict(zip(patterns, probable.tolist(), strict=True))
    # The train_docs smallest hashes of distinct texts, however often a text is repeated; only then the texts.
    h = F.xxhash64("text")
    hashes = materialise(texts.select(h.alias("h")).distinct())
    low = hashes.filter(among_lowest(F.col("h"), F.lit(hashes.count()), train_docs))
    least = low.orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    near = texts.filter(h <= least).select(h.alias("h"), "text").distinct()
    rows = near.mapInArrow(_featured, "h long, votes string, at binary, value binary").orderBy("h", "at", "value").limit(train_docs).collect()
    x, p = np.zeros((len(rows), DIMENSIONS), np.float32), np.zeros(len(rows))
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.at, np.int32)] = np.frombuffer(r.value, np.float32)
        p[i] = label[tuple("01-".index(c) if c != "-" else NONE for c in r.votes)]
    return fit_scorer(x, p), info


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, score (P(good), 0 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [float(features(t, statistics(t)) @ weights[:-1] + weights[-1]) for t in (t.as_py() or "" for t in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -50, 50))))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of docs: id_col, score, kept (score >= threshold).

    A null text counts as empty, an empty one is judged like any other; equal texts get equal
    scores; other columns are ignored."""
    weights, _ = fit(docs, text_col, train_docs)
    return score(docs, weights, id_col, text_col).withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, threshold: float = 0.3, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs whose text is kept, with the same columns in the same order."""
    weights, _ = fit(docs, text_col, train_docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.array([float(features(t, statistics(t)) @ weights[:-1] + weights[-1]) for t in (t.as_py() or "" for t in b.column(at))], float)
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
