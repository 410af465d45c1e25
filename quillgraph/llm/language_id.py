"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties, calibrated by a temperature.
Document frequencies are counted over all labelled texts; the classifier is fitted on a bounded
sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import in_parts, map_texts, table

#: n-grams of 1 to ORDERS characters are hashed to 2^BITS features.
ORDERS, BITS = 3, 16
#: How many labelled texts of each language fit the classifier, about; every fifth of them calibrates it.
PER_LANGUAGE = 400
UNKNOWN = "und"
_LETTER = np.array([chr(k).isalpha() for k in range(0x10000)])


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of a whole text's n-grams: lowered, runs of anything but letters as one space."""
    codes = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.where(codes < 0x10000, _LETTER[np.minimum(codes, 0xFFFF)], True)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    codes = codes[np.concatenate(([True], letter[1:] | letter[:-1]))]
    counts = np.zeros(1 << BITS, np.int64)
    for start in range(0, len(codes), 1 << 20):
        run, mixed = codes[start : start + (1 << 20) + ORDERS - 1], np.uint64(0)
        for n in range(1, ORDERS + 1):
            left = min(1 << 20, len(run) - n + 1)
            if left <= 0:
                break
            mixed = (mixed[:left] if n > 1 else mixed) * np.uint64(0x100000001B3) + run[n - 1 : n - 1 + left] + np.uint64(n)
            counts += np.bincount((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (languages, features + 1), the last one the bias
    temperature: float = 1.0

    def scale(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF of unit length, and the bias."""
        x = np.log1p(counts) * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return np.append(at, 1 << BITS), np.append(x / norm if norm else x, 1.0)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at, x = self.scale(at, counts)
        return self.weights[:, at] @ x

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 for a text without a letter or an unfitted model."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*features(text)) / self.temperature)
        return self.languages[k := int(p.argmax())], float(min(1.0, p[k]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(model: Model, samples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 5, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """FTRL-proximal over (language, feature, count) samples in a fixed random order; every fifth is left for the temperature."""
    rng = np.random.Generator(np.random.PCG64(7))
    z = np.zeros_like(model.weights)
    n = np.zeros_like(model.weights)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    train = [(y, *model.scale(at, c)) for k, (y, at, c) in enumerate(samples) if k % 5 or len(samples) < 10]
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            y, at, x = train[k]
            w = weights(z[:, at], n[:, at])
            p = _softmax(w @ x)
            p[y] -= 1
            g = np.outer(p, x)
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / alpha
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    model.weights = weights(z, n)
    held = samples[::5]
    if held:
        logits, labels = np.array([model.logits(at, c) for _, at, c in held]), np.array([y for y, _, _ in held])

        def loss(log_t: float) -> float:
            return -np.log(np.maximum(_softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels], 1e-12)).mean()

        low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
        while high - low > 1e-3:
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows with text and lang; rows where either is NULL are left out.

    All of them count for the document frequencies. About per_language rows of each language, picked by their
    key's hash, fit the classifier; the driver sees their feature counts only. Without rows, the model knows no language.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang")).where("t IS NOT NULL AND lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    model = Model(sorted(sizes), np.ones(1 << BITS), np.zeros((len(sizes), (1 << BITS) + 1)))
    if not sizes:
        return model

    def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int64)
        for b in in_parts(batches, "t"):
            for t in b.column("t").to_pylist():
                seen[features(t)[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["f", "n"])

    found = rows.select("t").mapInArrow(document_frequencies, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    df[found["f"].to_numpy()] = found["n"].to_numpy()
    model.idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1

    span = 1 << 30
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, per_language / n) * span))])
    picked = rows.withColumn("h", F.xxhash64("k")).where(F.pmod(F.col("h"), F.lit(span)) < shares[F.col("lang")])

    def count(texts: list) -> tuple:
        found = [features(t) for t in texts]
        return None, [[at for at, _ in found], [np.minimum(c, 1 << 30) for _, c in found]]

    sample = map_texts(picked, "t", "f array<int>, n array<int>", count).drop("k").toPandas()
    sample["size"] = sample["n"].map(sum)
    sample = sample.sort_values(["h", "lang", "size"], kind="stable")
    index = {x: k for k, x in enumerate(model.languages)}
    return fit(model, [(index[y], np.asarray(at), np.asarray(c)) for y, at, c in zip(sample["lang"], sample["f"], sample["n"], strict=True)])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: bool = False) -> DataFrame:
    """docs with ``lang_pred`` and ``score`` in place of the text, or beside it if ``keep``. The model is broadcast: languages x 2^BITS weights at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(texts: list) -> tuple:
        found = [shared.value.predict(t) for t in texts]
        return None, [[x for x, _ in found], [p for _, p in found]]

    return map_texts(docs, text, "lang_pred string, score double", each, keep)


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3; NULL keys are neither held out nor learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """``(key, held_out, lang_pred, score)`` for every row, by a model of the rows that are not held out.

    lang_pred is ``und`` and score 0 where the text is NULL or has no letter. Keys may repeat; a NULL key is
    predicted but not learned from. Neither lang nor any other column but text is an input of a prediction.
    """
    out = held_out(F.col(key))
    model = train(docs.where(F.col(key).isNotNull() & ~out), key, text, lang, per_language)
    return predict(docs.select(F.col(key), out.alias("held_out"), F.col(text)), model, text)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
