"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-Proximal (operator 8).

A text is a sparse vector of hashed word unigrams and bigrams. Training runs as several independent
follow-the-regularised-leader learners on disjoint parts of a bounded sample of labelled rows, one task
each; their weights are averaged. Scoring is a sparse dot product inside one scan of the documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the hashed feature space. The model is one float per feature: 1 MB, whatever the corpus.
DIM = 1 << 18
#: Most labelled documents that training reads (a documented bound); all documents are scored.
TRAIN_ROWS = 24_000
#: Rows of one learner: the sample is dealt to as many independent learners as that takes.
LEARNER_ROWS = 2_000
#: FTRL-Proximal's rates and penalties, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 0.01, 0.0, 24
THRESHOLD = 0.3

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


#: Grams of their own, which no token spells: how many words stand in capitals, how many tokens twice in a row.
CAPITALS, TWICE = "^^", "=="


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text: relative frequencies of lower-case word 1- and 2-grams, square-rooted.

    Two more grams count words in capitals and tokens that stand twice in a row, so that shouting and
    stuttering look alike in every language.
    """
    grams: Counter = Counter()
    total, last = 0, None
    for tokens in _pieces(text or ""):
        low = [t.lower() for t in tokens]
        pairs = list(zip(low, low[1:]) if last is None else zip([last, *low], low))
        grams.update(low)
        grams.update(f"{a} {b}" for a, b in pairs)
        for mark, n in ((CAPITALS, sum(len(t) > 1 and t.isupper() for t in tokens)), (TWICE, sum(a == b for a, b in pairs))):
            if n:
                grams[mark] += n
        total += len(low)
        last = low[-1] if low else last
    if not total:
        return np.array([0], dtype=np.int32), np.array([1.0])
    index = np.fromiter((1 + zlib.crc32(g.encode()) % (DIM - 1) for g in grams), dtype=np.int32, count=len(grams))
    value = np.sqrt(np.fromiter(grams.values(), dtype=np.float64, count=len(grams)) / total)
    return np.append(index, 0).astype(np.int32), np.append(value, 1.0)  # feature 0 is the intercept


def _pieces(text: str, size: int = 1 << 20) -> Iterator[list[str]]:
    """The tokens of a text, about a million characters at a time, cut at white space only."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text) and (m := re.compile(r"\s").search(text, end)):
            end = m.end()
        elif end < len(text):
            end = len(text)
        yield TOKEN.findall(text, at, end)
        at = end


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of one FTRL-Proximal learner over (indices, values, label) rows, in the order given."""
    z, n = np.zeros(DIM), np.zeros(DIM)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, x, y in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            # an index may stand twice in a row (two grams of one hash): np.add.at sums both
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            np.add.at(z, i, g - sigma * w)
            np.add.at(n, i, g * g)
    return weights(np.arange(DIM))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> np.ndarray | None:
    """Model weights from ``labels(doc_id, quality)``; None if no row is usable.

    Only rows with quality 0 or 1 and ``crc32(doc_id) mod 5 <> 0`` are learnt from. Where more than ``max_rows``
    documents have such a label, those with the least hash of id and text are taken, by a threshold: ``max_rows``
    of them, give or take a few in a hundred. Rows equal in id and text are learnt from once. What comes back to
    the driver is one sparse weight vector of each learner, bounded by ``DIM``.
    """
    usable = labels.where("quality in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    by = lambda salt: F.xxhash64("doc_id", "text", F.lit(salt))
    n = docs.select("doc_id", by("sample").alias("h")).join(usable, "doc_id").select("h").distinct().count()
    if not n:
        return None
    sampled = F.pmod(by("sample"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_rows / n))
    learners = -(-min(n, max_rows) // LEARNER_ROWS)
    texts = docs.select("doc_id", "text").where(sampled).join(usable, "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [features(t.as_py()) for t in b.column(1)]
            yield pa.record_batch(
                [b.column(0), b.column(2), b.column(3), pa.array([i for i, _ in both], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in both], pa.list_(pa.float32()))],
                ["learner", "quality", "order", "i", "x"],
            )

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order", kind="stable")
        rows = [(np.asarray(i), np.asarray(x, dtype=np.float64), int(y)) for i, x, y in zip(pdf["i"], pdf["x"], pdf["quality"])]
        w = train(rows)
        (at,) = np.nonzero(w)
        return pd.DataFrame({"i": [at.astype(np.int32)], "w": [w[at]]})

    rows = texts.select(F.pmod(by("learner"), F.lit(learners)).cast("int").alias("learner"), "text", "quality", by("order").alias("order"))
    parts = (
        rows.mapInArrow(hashed, "learner int, quality int, order long, i array<int>, x array<float>")
        .dropDuplicates(["learner", "order"])
        .groupBy("learner")
        .applyInPandas(learn, "i array<int>, w array<double>")
        .collect()  # one row of each learner, a dozen
    )
    model = np.zeros(DIM)
    for p in parts:
        model[np.asarray(p["i"], dtype=np.int64)] += np.asarray(p["w"]) / len(parts)
    return model


def held_out(column: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scorer(docs: DataFrame, model: np.ndarray | None):
    """The score of a text as a Column function. Without a model every score is 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(np.zeros(DIM, np.float32) if model is None else model.astype(np.float32))

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = sent.value.astype(np.float64)
        for s in texts:
            dots = np.array([float(w[i] @ x) for i, x in map(features, s)])
            yield pd.Series(1 / (1 + np.exp(-np.clip(dots, -35, 35))))

    return run


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``, learnt from ``labels``.

    Repeated rows are scored each; a doc_id with two labels counts as its larger one; an empty table
    gives an empty result. A null doc_id is never learnt from and not held out.
    """
    run = scorer(docs, fit(docs, labels, max_rows))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), run("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, with all its columns, without the documents predicted to be of low quality.

    A null text is scored as an empty one; repeated rows are scored alike; a null doc_id is never learnt from.
    Without a usable label every score is 0.5, so all documents stay. An empty table gives an empty result.
    """
    return docs.where(scorer(docs, fit(docs, labels))("text") >= THRESHOLD)
