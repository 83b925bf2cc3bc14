"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts that are confirmed toxic, the rest of the training rows is
unlabelled text, toxic or not. The risk of a linear classifier over hashed
word and character n-grams is prior * risk(positives as 1) + max(0,
risk(unlabelled as 0) - prior * risk(positives as 0)); where the second term
falls below zero the step goes against it, so that a flexible model doesn't
learn the unlabelled toxic texts by heart. The prior is the share of toxic
rows among labelled training rows.

Training reads labels and texts only of rows whose crc32 of the id as text is
not a multiple of ``FOLDS``: at most ``POSITIVES`` toxic and ``UNLABELLED``
other ids, those of least hash. Buckets are kept by how far their frequency
among positives departs from that among unlabelled texts (at most ``KEPT``).
All documents are scored; id, language, source and labels are no inputs.

Rows: null and empty texts score what the bias says; an id that is null counts
as the empty string in the fold; repeated rows score alike. Without a toxic
training row every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks
from .hashed import Adam, Spec, features, scores, sigmoid
from .tables import bounded_batches, table

POSITIVES, UNLABELLED, FOLDS, KEPT = 2500, 6000, 5, 1 << 14
SPEC = Spec(bits=20, word_sizes=(1,), char_sizes=(5,), lower=True)
_ROUNDS, _DECAY = 300, 1e-4


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


def _document_frequency(parts: list[str]) -> np.ndarray:
    """In how many of the texts each bucket occurs."""
    out = np.zeros(1 << SPEC.bits, np.int64)
    for block in blocks(pa.array(parts, pa.string())):
        for index, counts in features(block, SPEC):
            owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts) << SPEC.bits
            out += np.bincount(np.unique(owner | index) & ((1 << SPEC.bits) - 1), minlength=len(out))
    return out


def _chosen(positive: np.ndarray, unlabelled: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Buckets whose log odds depart most from even, weighted by how often they occur."""
    odds = np.log((positive + 0.5) / (n_p + 1)) - np.log((unlabelled + 0.5) / (n_u + 1))
    gain = np.abs(odds) * np.sqrt(positive + unlabelled)
    gain[(positive + unlabelled < 4) | (np.abs(odds) < 0.3)] = 0
    best = np.argsort(-gain, kind="stable")[:KEPT]
    return best[gain[best] > 0]


def _sparse(texts: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, chosen bucket) of every n-gram in a chosen bucket."""
    rows, cols, first = [], [], 0
    for block in blocks(pa.array(texts, pa.string())):
        for index, counts in features(block, SPEC):
            at = place[index]
            hit = np.flatnonzero(at >= 0)
            rows.append(np.repeat(np.arange(first, first + len(counts)), counts)[hit])
            cols.append(at[hit])
        first += len(block)
    return np.concatenate(rows), np.concatenate(cols)


def train(positive: list[str], unlabelled: list[str], prior: float) -> dict:
    """Weights over all buckets (zero outside the chosen ones) and bias."""
    n_p, n_u = len(positive), len(unlabelled)
    chosen = _chosen(_document_frequency(positive), _document_frequency(unlabelled), n_p, n_u)
    place = np.full(1 << SPEC.bits, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    rows, cols = _sparse([*positive, *unlabelled], place)
    is_p = np.arange(n_p + n_u) < n_p
    w, b = np.zeros(max(len(chosen), 1), np.float32), np.full(1, np.log(prior / (1 - prior)), np.float32)
    move, shift = Adam(w.shape, 0.02), Adam(b.shape, 0.02)
    for _ in range(_ROUNDS):
        z = np.bincount(rows, w[cols], n_p + n_u) + b[0]
        q = sigmoid(z)
        surplus = np.logaddexp(0, z[~is_p]).mean() - prior * np.logaddexp(0, z[is_p]).mean()
        as_one, as_zero = np.where(is_p, prior * (q - 1) / n_p, 0), np.where(is_p, -prior * q / n_p, q / n_u)
        g = as_one + as_zero if surplus >= 0 else -as_zero
        move.step(w, np.bincount(cols, g[rows], len(w)).astype(np.float32) + _DECAY * w)
        shift.step(b, g.sum(keepdims=True).astype(np.float32))
    full = np.zeros(1 << SPEC.bits, np.float32)
    full[chosen] = w[: len(chosen)]
    return {"weights": full.tobytes(), "bias": float(b[0])}


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The classifier, trained in one task on the bounded samples; None without a toxic training row."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("label"))
    )
    prior = known.agg(F.avg("label")).first()[0]
    if not prior:
        return None
    prior = min(max(float(prior), 1e-4), 0.9)
    order = [F.xxhash64("id"), F.col("id")]
    toxic = known.where("label = 1").orderBy(*order).limit(POSITIVES).select("id", F.lit(1).alias("positive"))
    others = docs.where(F.col(id_col).isNotNull() & (fold(id_col) != 0)).select(F.col(id_col).alias("id")).distinct()
    others = others.orderBy(*order).limit(UNLABELLED).select("id", F.lit(0).alias("positive"))
    chosen = F.broadcast(toxic.unionByName(others))  # bounded by the two limits
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id")
    texts = texts.groupBy("id", "positive").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"id": [], "positive": [], "text": []}), *frames]).sort_values("id")
        toxic = (rows["positive"] == 1).to_numpy()
        if toxic.any() and not toxic.all():
            yield pd.DataFrame([train(rows["text"][toxic].tolist(), rows["text"][~toxic].tolist(), prior)])

    made = texts.repartition(1).mapInPandas(task, "weights binary, bias double").collect()
    return made[0].asDict() if made else None


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id and score: the probability that the text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        w = np.frombuffer(model["weights"], np.float32) if model else None
        for batch in batches:
            for block in blocks(batch.column(1)):
                z = sigmoid(scores(features(block, SPEC), w, model["bias"], mean=False)) if model else np.zeros(len(block))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(z)], ["id", "score"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fitted(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
