"""Quality rules: counted base rules, then a calibrated classifier of hashed n-grams.

The classifier is a logistic regression over hashed word and character
n-grams (means of weights for each kind), trained on at most ``SAMPLE``
labelled rows (those of least hash of their id, so the same for any order or
partitioning). A fifth of these rows is kept from training and fits Platt's
scaling, which turns scores into probabilities of good quality. All documents
are scored in Arrow batches against the fixed ``THRESHOLD``.

Rows: null and empty texts have no words and fail the base rules. Labels that
are null, or of no document, are ignored; an id labelled twice counts with its
least label, and an id with several texts with one of them. Without both
labels in the sample there is no classifier and its verdict is to keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import SPACE, Block, blocks, mix, per_document, prefix_hash, window_hash, words
from .hashed import Adam, Spec, features, gram, scores, sigmoid
from .pieces import PieceIndex
from .tables import bounded_batches, table

SAMPLE = 4000
THRESHOLD = 0.25
SPEC = Spec(bits=18, word_sizes=(1, 2), char_sizes=(4,), lower=False)
MIN_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
_SCALE, _ROUNDS, _DECAY = 8.0, 60, 1e-6

#: The characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    data, at = block.data, block.offsets
    sizes = np.diff(at)
    starts, ends, counts = words(block)
    out = {
        "n_words": counts.astype(np.int64),
        "word_chars": per_document(sizes, (~SPACE[data] & ((data & 0xC0) != 0x80)).astype(np.int64)),
        "n_symbols": per_document(sizes, SYMBOLS[data].astype(np.int64)),
    }
    again = np.zeros(len(block), np.int64)
    raw = data.tobytes()
    for i in np.unique(np.searchsorted(at, np.flatnonzero(data == 0x0A), side="right") - 1):
        lines = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x.strip()]
        again[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = again
    grams, each = gram(window_hash(prefix_hash(data), starts, ends), counts, WINDOW)
    owner = np.repeat(np.arange(len(block), dtype=np.uint64), each)
    keys = mix(grams ^ mix(owner + np.uint64(1)))
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(twice):
        place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = np.flatnonzero(twice[place] == keys)
        first = np.repeat(np.cumsum(counts) - counts, each) + np.arange(len(grams)) - np.repeat(np.cumsum(each) - each, each)
        hit = _equal_windows(data, hit, owner, first, starts, ends)
        np.add.at(covered, first[hit], 1)
        np.add.at(covered, first[hit] + WINDOW, -1)
    out["n_repeat_words"] = per_document(counts, (np.cumsum(covered)[:-1] > 0).astype(np.int64))
    return out


def _equal_windows(data: np.ndarray, hit: np.ndarray, owner: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of windows whose hash occurs twice in their document, those whose words do.

    Words are numbered by their bytes, runs of 2, 4 and 8 words by the numbers of their halves.
    """
    if not len(hit):
        return hit
    number, _ = PieceIndex(len(starts)).number(data, starts, ends)
    size = 1
    while size < WINDOW:
        number = np.unique(number[:-size] * len(starts) + number[size:], return_inverse=True)[1]
        size *= 2
    key = owner[hit].astype(np.int64) * len(starts) + number[first[hit]]
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    return hit[times[place] > 1]


def train(texts: list[str], labels: np.ndarray) -> dict:
    """Weights, bias and calibration (slope, offset) of P(label 1)."""
    labels = labels.astype(np.float32)
    fit = np.arange(len(labels)) % 5 != 0
    # features of a few hundred documents at a time: nothing but the bucket numbers is held for all
    parts, first = [], 0
    for block in blocks(pa.array(texts, pa.string()), 1 << 20):
        parts.append((slice(first, first + len(block)), features(block, SPEC)))
        first += len(block)
    w, b = np.zeros(1 << SPEC.bits, np.float32), np.zeros(1, np.float32)
    move, shift = Adam(w.shape, 0.3), Adam(b.shape, 0.05)

    def linear() -> np.ndarray:
        return np.concatenate([scores(kinds, w, 0.0, mean=True) for _, kinds in parts]) * _SCALE + b[0]

    for _ in range(_ROUNDS):
        g = np.where(fit, sigmoid(linear()) - labels, 0).astype(np.float32) / fit.sum()
        slope = _DECAY * w
        for rows, kinds in parts:
            for index, counts in kinds:
                slope += np.bincount(index, np.repeat(g[rows] * _SCALE / np.maximum(counts, 1), counts), len(w)).astype(np.float32)
        move.step(w, slope)
        shift.step(b, g.sum(keepdims=True))
    z = linear()
    return {"weights": w.tobytes(), "bias": float(b[0]), **calibrate(z[~fit], labels[~fit])}


def calibrate(z: np.ndarray, y: np.ndarray) -> dict:
    """Platt's scaling by Newton steps, with his smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(float(np.abs(z).max(initial=0)), 1e-6)
    x, p = np.stack([z / scale, np.ones_like(z)], axis=1), np.array([1.0, 0.0])

    def loss(p: np.ndarray) -> float:
        u = x @ p
        return float((np.logaddexp(0, u) - t * u).sum() + 1e-3 * p @ p)

    for _ in range(100):
        q = sigmoid(x @ p)
        h = (x * (q * (1 - q))[:, None]).T @ x + 2e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (q - t) + 2e-3 * p)
        while np.abs(step).max() > 1e-9 and loss(p - step) > loss(p):
            step = step / 2
        p = p - step
        if np.abs(step).max() <= 1e-9:
            break
    return {"slope": float(p[0]) / scale, "offset": float(p[1])}


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, label, text of at most ``most`` labelled ids, those of least hash."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label).alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(most))  # bounded by ``most``
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id")
    return texts.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> dict | None:
    """The classifier, trained in one task on the bounded sample."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"id": [], "label": [], "text": []}), *frames]).sort_values("id")
        y = rows["label"].to_numpy(np.float32)
        if len(set(y[np.arange(len(y)) % 5 != 0])) > 1 and len(y) >= 10:
            yield pd.DataFrame([train(rows["text"].tolist(), y)])

    made = sample(docs, labels, label, most).repartition(1).mapInPandas(task, "weights binary, bias double, slope double, offset double").collect()
    return made[0].asDict() if made else None


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"


def judge(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Counts and verdict of each row: columns id and OUT, or all columns of ``docs`` and those of OUT."""
    bounded_batches(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = weights.value
        w = np.frombuffer(model["weights"], np.float32) if model else None
        for batch in batches:
            for block in blocks(batch.column(batch.schema.get_field_index("__text"))):
                out = base_counts(block)
                out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
                if model:
                    z = scores(features(block, SPEC), w, 0.0, mean=True) * _SCALE + model["bias"]
                    out["quality_score"] = sigmoid(model["slope"] * z + model["offset"])
                else:
                    out["quality_score"] = np.ones(len(block))
                out["kept"] = ~out["base_failed"] & (out["quality_score"] >= THRESHOLD)
                own = batch.slice(block.first, len(block))
                keep = [i for i, n in enumerate(own.schema.names) if n != "__text"]
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in keep), *map(pa.array, out.values())], [*(own.schema.names[i] for i in keep), *out])

    first = [F.col(c) for c in docs.columns] if carry else [F.col(id_col).alias("id")]
    rows = docs.select(*first, F.col(text_col).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(task, f"{fields}, {OUT}")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with its columns, whose verdict is to keep.

    The verdicts' columns have names of their own while they are beside those of ``docs``.
    """
    taken = {f"__{i}": c for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in taken.items()])
    name = {c: n for n, c in taken.items()}
    judged = judge(renamed, fitted(docs, labels), name[id_col], name[text_col], carry=True)
    return judged.where("kept").select(*[F.col(n).alias(c) for n, c in taken.items()])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fitted(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
