"""Quality classifier: EM over the votes of overlapping heuristics, whose posteriors train a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, documents, materialise, raw, slices, string_array, text_column

BUCKETS = 1 << 16
SAMPLE = 6000  # rows that the linear scorer is fitted on, about; the votes are counted over all rows
KEEP = 0.5


def statistics(text: Column) -> dict[str, Column]:
    """Numbers of a text that the labellers look at."""
    n = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    letters = F.greatest(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.lit(1))
    return {
        "n_words": F.size(words).cast("double"),
        "marks": F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,;:?'\"()+=@_/-]+", "")) / n,
        "letters": letters / n,
        "upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / letters,
        "distinct_words": F.size(F.array_distinct(words)) / F.sqrt(F.greatest(F.size(words), F.lit(1))),
        "distinct_lines": F.when(F.size(lines) > 2, F.size(F.array_distinct(lines)) / F.size(lines)),
        "word_length": F.length(F.regexp_replace(text, r"\s+", "")) / F.greatest(F.size(words), F.lit(1)),
        "ended": F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"[.!?:]$"))) / F.greatest(F.size(lines), F.lit(1)),
        "breaks": F.size(F.filter(words, lambda w: w.rlike(r"([^\p{L}\p{N}\s.])\1+$|^[^\p{L}\p{N}]+$"))) / F.greatest(F.size(words), F.lit(1)),
        "repeats": F.regexp_count(text, F.lit(r"(?<!\S)(\S++)\s+\1(?!\S)")) / F.greatest(F.size(words), F.lit(1)),
    }


def votes(s: dict[str, Column] | None = None) -> dict[str, Column]:
    """Votes of the labellers by their statistics: 1 good, 0 bad, null none.

    Of labellers that see the same flaw only one may call a text good: their agreement would count as if they were
    independent, and a text bad in another way would be outvoted.
    """
    s = s or {k: F.col(k) for k in ("n_words", "marks", "letters", "upper", "distinct_words", "distinct_lines", "word_length", "ended", "breaks", "repeats")}

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    return {
        "v_marks": vote(s["marks"] < 0.01, s["marks"] > 0.04),
        "v_letters": F.when(s["letters"] < 0.4, 0),
        "v_upper": vote(s["upper"] < 0.1, s["upper"] > 0.3),
        "v_repeats": F.when(s["n_words"] >= 5, vote(s["repeats"] < 0.02, s["repeats"] > 0.1)),
        "v_distinct": F.when((s["n_words"] >= 50) & (s["distinct_words"] < 1), 0),
        "v_lines": vote(s["distinct_lines"] > 0.9, s["distinct_lines"] < 0.6),
        "v_ended": F.when(s["ended"] > 0.7, 1),
        "v_breaks": F.when(s["breaks"] > 0.15, 0),
        "v_words": F.when(s["n_words"] == 0, 0),
    }


NAMES = ["v_marks", "v_letters", "v_upper", "v_repeats", "v_distinct", "v_lines", "v_ended", "v_breaks", "v_words"]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of ``good`` by vote pattern, (labeller, class) accuracies for bad and good rows, the share of good rows, by EM.

    ``patterns``: rows of 1, 0 or -1 (no vote); ``counts``: how many documents voted so. Texts are bad in different ways, each
    seen by few labellers, so the latent class is good or one bad kind for each labeller; given the class, votes are
    independent. The labeller of a bad kind calls it bad in nine cases of ten at least, and no labeller calls more than
    a twentieth of the good ones bad; all else is estimated, with Beta priors as of 10 votes.
    """
    n, m = patterns.shape
    yes, no = (patterns == 1).astype(float), (patterns == 0).astype(float)
    own = np.vstack([np.zeros((1, m)), np.eye(m)]).astype(bool)  # class 0 is good
    prior = np.where(own, 0.05, 0.7)
    prior[0] = 0.98
    some = np.maximum(no.sum(1, keepdims=True), 1)
    belong = np.hstack([np.where(no.any(1, keepdims=True), 0.05, 0.95), np.where(no.any(1, keepdims=True), 0.95 * no / some, 0.05 / m)])
    posterior, theta, share = belong[:, 0], prior, np.full(m + 1, 1 / (m + 1))
    for _ in range(rounds):
        weight = belong * counts[:, None]
        theta = (weight.T @ yes + 10 * prior) / (weight.T @ (yes + no) + 10)
        theta = np.where(own, np.clip(theta, 1e-4, 0.1), np.clip(theta, 1e-4, 1 - 1e-4))
        theta[0] = np.maximum(theta[0], 0.95)
        share = (weight.sum(0) + 1) / (counts.sum() + m + 1)
        log = np.log(share) + yes @ np.log(theta).T + no @ np.log1p(-theta).T
        log -= log.max(1, keepdims=True) if n else 0
        belong = np.exp(log)
        belong /= belong.sum(1, keepdims=True)
        done, posterior = np.abs(belong[:, 0] - posterior).max(initial=0) < 1e-9, belong[:, 0]
        if done:
            break
    bad = 1 - share[1:] @ theta[1:] / share[1:].sum()
    return posterior, np.stack([bad, theta[0]], 1), float(share[0])


def _pattern() -> Column:
    return F.concat_ws("", *[F.coalesce(v.cast("string"), F.lit("-")) for v in votes().values()])


def hashed(texts: pa.StringArray, shape: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text: shares of its hashed byte trigrams, and one hashed token for each statistic's range."""
    buffer, offsets = raw(texts)
    wide = np.concatenate([buffer, np.zeros(2, np.uint8)]).astype(np.uint32)
    grams = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) if len(buffer) else np.zeros(0, np.uint32)
    grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    out = []
    for k in range(len(texts)):
        a, b = int(offsets[k]), max(int(offsets[k]), int(offsets[k + 1]) - 2)
        part = grams[a:b]
        out.append((np.concatenate([part, shape[k]]), np.concatenate([np.full(len(part), 4.0 / max(1, len(part)), np.float32), np.ones(shape.shape[1], np.float32)])))
    return out


RANGES = {"n_words": [1, 5, 20, 100, 1000], "marks": [0.005, 0.01, 0.02, 0.04, 0.1], "letters": [0.4, 0.6, 0.7, 0.75, 0.8], "upper": [0.03, 0.1, 0.2, 0.3, 0.6], "distinct_words": [0.5, 1, 1.5, 2, 3, 5], "distinct_lines": [0.3, 0.6, 0.8, 0.9], "word_length": [2.5, 4, 6, 8, 9.5, 14], "ended": [0.2, 0.5, 0.7, 0.9], "breaks": [0.02, 0.05, 0.1, 0.15, 0.3], "repeats": [0.01, 0.02, 0.05, 0.1, 0.3]}


def shapes(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Buckets of each statistic's range; a missing statistic has a range of its own."""
    out = []
    for i, (name, edges) in enumerate(RANGES.items()):
        x = columns[name].astype(float)
        at = np.where(np.isnan(x), 99, np.searchsorted(edges, np.nan_to_num(x), "right"))
        out.append(((i * 101 + at + 1) * 0x9E3779B1 >> 7) % BUCKETS)
    return np.stack(out, 1).astype(np.uint32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, rate: float = 0.5) -> np.ndarray:
    """Weights (the last one the bias) of a logistic scorer on probabilities as labels: AdaGrad in a fixed order."""
    w, square = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-2)
    merged = []
    for at, x in rows:
        used, inverse = np.unique(at, return_inverse=True)
        merged.append((np.append(used, BUCKETS), np.append(np.bincount(inverse, x), 1.0)))
    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(epochs):
        for k in order.permutation(len(merged)):
            at, x = merged[k]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30)))
            g = (p - labels[k]) * x + 1e-6 * w[at]
            square[at] += g * g
            w[at] -= rate * g / np.sqrt(square[at])
    return w


def _read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in RANGES}


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, sample: int = SAMPLE) -> tuple[DataFrame, dict]:
    """One row per input row: doc_id, n_votes, posterior, score, keep; and what was learned.

    The votes' patterns (at most 3 to the power of the labellers) are counted over all rows; EM on the counts gives the
    accuracies, without any labels. The scorer learns the posteriors of about ``sample`` rows, chosen by a hash of id and
    text, and then scores every whole text. Null texts count as empty: posterior and score like other empty texts.
    Repeated rows: repeated results. Empty input: empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(col(id_col).alias("id"), text_column(text_col).alias("t"))
    # written once with the texts: all that follows reads them, and no statistic is computed again
    base = base.select("id", "t", *[v.cast("double").alias(k) for k, v in statistics(F.col("t")).items()])
    base = materialise(base.withColumn("pattern", _pattern()), "quality-statistics")
    found = base.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** 9 rows
    patterns = np.array([[{"1": 1, "0": 0}.get(c, -1) for c in r.pattern] for r in found]).reshape(len(found), len(NAMES))
    counts = np.array([r.n for r in found], float)
    posterior, accuracy, share = estimate(patterns, counts)
    belief = {r.pattern: float(p) for r, p in zip(found, posterior, strict=True)}
    share_of = min(1.0, sample / max(1.0, counts.sum()))
    chosen = base.withColumn("h", F.xxhash64(F.lit(11), F.col("id").cast("string"), F.col("t"))).where(F.pmod("h", F.lit(1 << 30)) < int(share_of * (1 << 30)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shape = string_array(batch.column(1)), shapes(_read(batch))
            for a, b in slices(texts):
                rows = [tuple(np.unique(at, return_inverse=True)) + (x,) for at, x in hashed(texts[a:b], shape[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column("pattern")[a:b], batch.column("h")[a:b], pa.array([u.astype(np.int32) for u, _, _ in rows], pa.list_(pa.int32())), pa.array([np.bincount(i, x).astype(np.float32) for _, i, x in rows], pa.list_(pa.float32()))], ["pattern", "h", "at", "x"])

    # in an order that does not depend on partitions; texts with equal hashes are the same
    sampled = chosen.mapInArrow(features, "pattern string, h long, at array<int>, x array<float>").toArrow().sort_by([("pattern", "ascending"), ("h", "ascending")])
    rows = [(at.values.to_numpy().astype(np.int64), x.values.to_numpy().astype(float)) for at, x in zip(sampled.column("at"), sampled.column("x"), strict=True)]
    labels = [belief[p] for p in sampled.column("pattern").to_pylist()]
    weights = fit(rows, np.array(labels)).astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shape = string_array(batch.column(1)), shapes(_read(batch))
            for a, b in slices(texts):
                z = np.array([weights[at] @ x for at, x in hashed(texts[a:b], shape[a:b])], np.float64) + float(weights[-1])
                pattern = batch.column("pattern")[a:b].to_pylist()
                n_votes = pa.array([len(p) - p.count("-") for p in pattern], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], n_votes, pa.array([belief[p] for p in pattern], pa.float64()), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["id", "n_votes", "posterior", "score"])

    out = base.mapInArrow(score, f"id {dict(base.dtypes)['id']}, n_votes int, posterior double, score double")
    out = out.withColumn("keep", F.col("score") >= keep).withColumnRenamed("id", id_col)
    return out, {"share": share, "accuracy": dict(zip(NAMES, accuracy.tolist(), strict=True)), "documents": int(counts.sum()), "weights": weights}


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))[0]
