"""Operator 6. Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document's text are standardised and mapped to random Fourier features, whose
inner products approximate a Gaussian kernel. Each partition sums its part of the normal
equations; their sum gives the ridge scores. The scores of labelled documents that took no
part in the fit are calibrated to probabilities by isotonic regression (pool adjacent violators).
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import col, fresh, map_rows, materialize, others, words_of
from lodestar.llm.quality_rules import text_counts
from lodestar.sources.shipping import ship

FEATURES = ["log_words", "word_length", "symbols", "capitals", "dup_lines", "repeats", "distinct", "top_word", "digits", "punctuation", "not_ascii", "line_words"]
RANDOM_FEATURES, BANDWIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 11
#: Calibration sums are kept for so many equal steps of the ridge score from -0.5 to 1.5.
STEPS = 2_000
#: So many partial sums (of half a megabyte) meet in one task, and on the driver.
MEET = 32

_digits = str.maketrans("", "", "0123456789")
_marks = str.maketrans("", "", ".,;:!?")


def statistics(text: str) -> list[float]:
    """FEATURES of one whole text; all zero without a word but log_words and line_words."""
    n, chars, symbols, dup_lines, repeats, capitals = text_counts(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words_of(text))
    size, lines = len(text), text.count("\n") + 1
    return [
        math.log1p(n),
        min(chars / n, 40.0),
        min(symbols / n, 4.0),
        capitals / chars,
        dup_lines / lines,
        repeats / n,
        len(counts) / n,
        max(counts.values()) / n,
        (size - len(text.translate(_digits))) / size,
        min((size - len(text.translate(_marks))) / n, 4.0),
        1 - len(text.encode("ascii", "ignore")) / size,
        math.log1p(n / lines),
    ]


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and x: FEATURES; a null text counts as empty."""
    keep = others(docs, text, "x")
    (read,) = fresh(docs, "text_read")

    def make():
        return lambda cols: {"x": [statistics(t or "") for t in cols[read]]}

    return map_rows(docs.select(*map(col, keep), col(text).alias(read)), make, "x array<double>", keep)


class FourierMap:
    """x -> sqrt(2 / D) cos(x W + b) on standardised x, and a constant."""

    def __init__(self, mean: list[float], scale: list[float], features: int = RANDOM_FEATURES, bandwidth: float = BANDWIDTH, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.array(mean), np.array(scale)
        self.w = r.normal(size=(len(mean), features)) / bandwidth
        self.b = r.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.hstack([z, np.ones((len(x), 1))])


def normal_equations(train: DataFrame, phi: FourierMap, fan: int = MEET) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of z z', z y and 1 over the rows (x, y): by partition, then ``fan`` sums at a time until ``fan`` are left."""
    ship(train.sparkSession)
    m = len(phi.b) + 1

    def pack(zz, zy, n):
        return np.concatenate([zz.ravel(), zy, [float(n)]]).tobytes()

    def partial(batches):
        zz, zy, n = np.zeros((m, m)), np.zeros(m), 0
        for pdf in batches:
            if len(pdf):
                z = phi(np.stack(pdf["x"].to_numpy()))
                zz += z.T @ z
                zy += z.T @ pdf["y"].to_numpy(dtype=float)
                n += len(pdf)
        if n:
            yield pd.DataFrame({"sums": [pack(zz, zy, n)]})

    def add(key, pdf):
        total = np.zeros(m * m + m + 1)
        for s in pdf["sums"]:
            total += np.frombuffer(s)
        return pd.DataFrame({"at": [key[0]], "sums": [total.tobytes()]})

    parts = train.select("x", "y").mapInPandas(partial, "sums binary").select(F.spark_partition_id().alias("at"), "sums")
    parts = materialize(parts, "normal-equations")
    while parts.count() > fan:  # no task holds more than fan sums, whatever the number of partitions
        parts = materialize(parts.withColumn("at", F.floor(F.col("at") / fan).cast("int")).groupBy("at").applyInPandas(add, "at int, sums binary"), "normal-equations")
    total = np.zeros(m * m + m + 1)
    for r in parts.collect():
        total += np.frombuffer(r["sums"])
    return total[: m * m].reshape(m, m), total[m * m : -1], int(total[-1])


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit to the shares ones / n at rising places: pool adjacent violators."""
    blocks: list[list[float]] = []  # ones, n, first place, last place
    for x, a, b in zip(at, ones, n, strict=True):
        blocks.append([a, b, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a2, b2, _, last = blocks.pop()
            blocks[-1][0] += a2
            blocks[-1][1] += b2
            blocks[-1][3] = last
    places = [p for b in blocks for p in (b[2], b[3])]
    return np.array(places), np.array([b[0] / b[1] for b in blocks for _ in (2, 3)])


def remainder(doc_id) -> object:
    """crc32 of the id as text, mod 3; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Learns from labelled rows whose id has remainder 0 (fit) and 2 (calibration); those with
    remainder 1 are held out and never seen. Null, empty and wordless texts have statistics
    zero and are scored like any. A label other than 0 or 1 is passed over; an id labelled twice
    counts as 1 if any label is. Repeated rows get equal scores. Without labels of both kinds
    to learn from, every score is the share of ones, or 0.5 without any; an empty table gives no rows.
    """
    named = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    rows = materialize(document_statistics(named).withColumn("fold", remainder(F.col("doc_id"))), "quality-statistics")
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    learn = materialize(rows.filter("fold <> 1").join(known, "doc_id").select("fold", "x", "y"), "quality-labelled")

    d = len(FEATURES)
    per = [f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]
    seen = learn.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("ones"), *[c.alias(f"s{i}") for i, c in enumerate(per)]).first()
    if not seen["n"] or seen["ones"] in (0.0, 1.0):
        score = F.lit(0.5 if not seen["n"] else float(seen["ones"]))
        return rows.select("doc_id", (F.col("fold") == 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    phi = FourierMap([seen[f"s{2 * i}"] for i in range(d)], [seen[f"s{2 * i + 1}"] or 1.0 for i in range(d)])
    zz, zy, n = normal_equations(learn.filter("fold = 0"), phi)
    if not n:
        zz, zy, n = normal_equations(learn, phi)
    weights = np.linalg.solve(zz + RIDGE * n * np.eye(len(zy)), zy)
    model = docs.sparkSession.sparkContext.broadcast((phi, weights))  # fixed size

    def ridge():
        f, w = model.value
        return lambda cols: {"raw": f(np.array(cols["x"]).reshape(-1, d)) @ w}

    step = F.least(F.greatest(F.floor((F.col("raw") + 0.5) * (STEPS / 2)), F.lit(0)), F.lit(STEPS - 1))
    held = map_rows(learn.filter("fold = 2").select("y", "x"), ridge, "raw double", ["y"], 2_000)
    sums = held.groupBy(step.alias("at")).agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()  # STEPS rows at most
    if sums:
        places, shares = isotonic(np.array([(r["at"] + 0.5) / (STEPS / 2) - 0.5 for r in sums]), np.array([float(r["ones"]) for r in sums]), np.array([float(r["n"]) for r in sums]))
    else:
        places, shares = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    knots = docs.sparkSession.sparkContext.broadcast((places, shares))

    def calibrated():
        raw, (p, s) = ridge(), knots.value

        def do(cols):
            score = np.clip(np.interp(raw(cols)["raw"], p, s), 0.0, 1.0)
            return {"score": score, "predicted": (score >= 0.5).astype(int)}

        return do

    return map_rows(rows.select("doc_id", (F.col("fold") == 1).alias("held_out"), "x"), calibrated, "score double, predicted int", ["doc_id", "held_out"], 2_000)
