"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._frames import map_frames
from tidemark.llm._text import batches

#: n-grams of 1 to ORDERS characters, hashed to 2**BUCKET_BITS features.
ORDERS, BUCKET_BITS = 3, 15
BUCKETS = 1 << BUCKET_BITS
#: The classifier is fitted on at most about so many labelled documents.
SAMPLE = 3000
#: More labels than this are an error: the model that is sent to all workers has 4 bytes for each feature and label, 34 MB at most.
MOST_LANGUAGES = 256
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def hashed_ngrams(text: str) -> np.ndarray:
    """The feature of every n-gram of the whole text, lower-cased."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out, rolled = [], np.zeros(len(c), np.uint32)
    for k in range(min(ORDERS, len(c))):
        rolled = rolled[: len(c) - k] * np.uint32(_ODD[0]) + c[k:] + np.uint32(1)
        spread = rolled * np.uint32(_ODD[1] + 2 * k)
        spread ^= spread >> np.uint32(15)
        out.append((spread * np.uint32(_ODD[2])) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text, in order, and how often each occurs."""
    found = hashed_ngrams(text)
    if len(found) < BUCKETS // 8:  # sorting a short text is less than going through all features
        return np.unique(found, return_counts=True)
    c = np.bincount(found, minlength=BUCKETS)
    on = np.flatnonzero(c)
    return on, c[on]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their weights (1 + ln tf) idf, of length 1."""
    on, c = counts(text)
    x = (1 + np.log(c)) * idf[on]
    norm = np.sqrt(x @ x)
    return on, x / norm if norm else x


class Ftrl:
    """Follow-the-regularised-leader for multinomial logistic regression, with per-weight rates and elastic-net penalties."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))  # the last row is the bias

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, on: np.ndarray, x: np.ndarray, label: int) -> None:
        rows, x = np.append(on, BUCKETS), np.append(x, 1.0)
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[rows]
        grown = n + g * g
        self.z[rows] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = grown


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on held-out documents, by golden sections of its logarithm."""
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean()
    a, b, g = np.log(0.02), np.log(50.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        on, x = vector(text, self.idf)
        return x @ self.weights[on] + self.weights[BUCKETS]


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and how many there are; over all documents.

    Null and empty texts don't count, repeated rows do; an empty table gives zeros. Other columns play no part.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        mark = np.zeros(BUCKETS, np.bool_)
        for frame in batches(frames, "text"):
            for text in frame.text:
                if text:
                    mark[:] = False
                    mark[hashed_ngrams(text)] = True
                    seen += mark
                    n += 1
        on = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(on, -1), "n": np.append(seen[on], n)})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    df = np.zeros(BUCKETS, np.int64)
    real = rows[rows.bucket >= 0]
    df[real.bucket.to_numpy()] = real.n.to_numpy()
    return df, int(rows.loc[rows.bucket < 0, "n"].sum())


def train(docs: DataFrame, sample: int = SAMPLE, epochs: int = 2, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> LanguageModel | None:
    """Fits on about ``sample`` labelled documents, chosen by a hash of doc_id; a fifth of them sets the temperature.

    Document frequencies are those of all documents. None where nothing is labelled (an
    empty table, null labels, null or empty texts). Ties of the hash are taken by id and
    text, repeated rows count; other columns play no part.
    """
    df, total = document_frequencies(docs, text_col)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang")).where((F.length("text") > 0) & F.col("lang").isNotNull())
    n = labelled.select("lang").count()
    if not n:
        return None
    rank = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52))
    chosen = labelled.where(rank < F.lit(min(1 << 52, int((1 << 52) * sample / n)))) if n > sample else labelled
    rows = chosen.withColumn("rank", rank).toArrow().to_pandas().sort_values(["rank", "id", "text"], kind="stable")
    if not len(rows):
        return None
    languages = sorted(rows.lang.unique())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} labels; {MOST_LANGUAGES} at most")
    idf = np.log((1 + total) / (1 + df)) + 1
    vectors = [vector(t, idf) for t in rows.text]
    labels = np.array([languages.index(v) for v in rows.lang])
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 10 else np.zeros(len(rows), bool)
    learner, random = Ftrl(len(languages)), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in random.permutation(np.flatnonzero(~held)):
            learner.learn(*vectors[k], labels[k])
    model = LanguageModel(languages, idf, learner.weights().astype(np.float32), 1.0)
    if held.any():
        logits = np.array([vectors[k][1] @ model.weights[vectors[k][0]] + model.weights[BUCKETS] for k in np.flatnonzero(held)])
        model.temperature = temperature(logits, labels[held])
    return model


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, language and its calibrated probability, from each whole text.

    - null or empty text, or no model: language and probability null.
    - null doc_id: handled as any other row. Repeated rows: each gives a row. Empty table: empty result.
    - other columns play no part, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(model)  # 2**15 features and MOST_LANGUAGES labels at most

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = known.value
        for frame in batches(frames, "text"):
            name, sure = [None] * len(frame), [None] * len(frame)
            for k, text in enumerate(frame.text):
                if text and m is not None:
                    p = softmax(m.logits(text) / m.temperature)
                    best = int(p.argmax())
                    name[k], sure[k] = m.languages[best], float(p[best])
            yield pd.DataFrame({"doc_id": frame.id.array, "language": name, "probability": pd.array(sure, "Float64")})

    return map_frames(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), predict, f"doc_id {kind}, language string, probability double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
