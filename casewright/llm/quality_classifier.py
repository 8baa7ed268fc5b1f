"""Quality classification by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A whole text is compressed with
each in blocks of a fixed length, every block afresh, so that no part of it is served by its own history in place of the
dictionaries; the difference of the two sums of sizes over their sum is turned into a probability by a logistic curve
fitted on the same measure of labelled texts that built neither dictionary.

Only a bounded sample of labelled rows is learned from (``ClassifierParams.sample_docs`` for each label, those with the
smallest id hash; texts above ``sample_bytes`` are left out of it); every whole text is scored.

Defined results: null and empty texts score as the corpus's share of good labels, since they hold no evidence; documents
whose label rows disagree are not learned from; null labels or ids are ignored; if a label is missing altogether the
share of good labels (1 where there are none) is the score of every text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


@dataclass(frozen=True)
class ClassifierParams:
    sample_docs: int = 1500
    sample_bytes: int = 20_000  # so that the samples of both labels are 60 MB at most
    dictionary_bytes: int = 65_536
    block_bytes: int = 1024
    level: int = 3
    threshold: float = 0.3


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    bias: float
    prior: float
    level: int
    block_bytes: int = ClassifierParams.block_bytes

    def differences(self, texts: list[str]) -> np.ndarray:
        """Normalised size differences: above 0 where the good dictionary serves better."""
        packers = [zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) for d in (self.good, self.bad)]
        out = np.zeros(len(texts))
        for k, t in enumerate(texts):
            if raw := t.encode("utf-8", "replace"):
                blocks = [raw[i : i + self.block_bytes] for i in range(0, len(raw), self.block_bytes)]
                good, bad = (sum(len(p.compress(b)) for b in blocks) for p in packers)
                out[k] = (bad - good) / (bad + good)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.good or not self.bad:
            return np.full(len(texts), self.prior)
        plain = [t or "" for t in texts]
        p = 1 / (1 + np.exp(-np.clip(self.slope * self.differences(plain) + self.bias, -50, 50)))
        return np.where([not t for t in plain], self.prior, p)


def _dictionary(texts: list[str], size: int) -> bytes:
    raw = [t.encode("utf-8", "replace") for t in texts]
    try:
        return zstandard.train_dictionary(size, raw).as_bytes()
    except zstandard.ZstdError:  # too few samples: their bytes are the dictionary
        return b"\n".join(raw)[-size:]


def fit_model(good: list[str], bad: list[str], prior: float, params: ClassifierParams = ClassifierParams()) -> CompressionModel:
    """Dictionaries from every other text of each label, the logistic curve from the rest. ``prior``: share of good labels."""
    good, bad = [t for t in good if t], [t for t in bad if t]
    if not good or not bad:
        return CompressionModel(b"", b"", 0.0, 0.0, prior, params.level, params.block_bytes)
    base = CompressionModel(_dictionary(good[::2], params.dictionary_bytes), _dictionary(bad[::2], params.dictionary_bytes), 0.0, 0.0, prior, params.level, params.block_bytes)
    held = [good[1::2] or good, bad[1::2] or bad]
    x = np.concatenate([base.differences(h) for h in held])
    y = np.repeat([1.0, 0.0], [len(h) for h in held])
    clipped = min(max(prior, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, clipped / y.sum(), (1 - clipped) / (len(y) - y.sum())) * len(y)
    scale = x.std() or 1.0
    a, b = 0.0, math.log(clipped / (1 - clipped))
    for _ in range(50):  # Newton steps with a small ridge on the slope
        p = 1 / (1 + np.exp(-np.clip(a * x / scale + b, -50, 50)))
        w = weight * p * (1 - p) + 1e-9
        g = np.array([(weight * (y - p) * x / scale).sum() - 0.1 * a, (weight * (y - p)).sum()])
        h = np.array([[(w * (x / scale) ** 2).sum() + 0.1, (w * x / scale).sum()], [(w * x / scale).sum(), w.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    return CompressionModel(base.good, base.bad, a / scale, b, prior, params.level, params.block_bytes)


def learn(docs: DataFrame, labels: DataFrame, params: ClassifierParams = ClassifierParams(), text: str = "text") -> CompressionModel:
    """Fit on the documents of ``labels`` (doc_id, label 0/1). Only the bounded sample comes to the driver."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    share = known.agg(F.avg("label").alias("share")).first()["share"]
    rows = []
    for label in (1, 0):
        ids = known.where(F.col("label") == label).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample_docs)
        sample = docs.select("doc_id", F.col(text).alias("text")).where(F.octet_length("text") <= params.sample_bytes)
        got = sample.join(F.broadcast(ids), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(params.sample_docs).collect()
        rows.append([r["text"] for r in got])
    return fit_model(rows[0], rows[1], 1.0 if share is None else share, params)


def score(docs: DataFrame, model: CompressionModel, text: str = "text") -> DataFrame:
    """Add ``score``, from 0 to 1, to each row. No shuffle; a batch of texts at a time."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sent.value.score(texts.where(texts.notna(), None).tolist()))

    return docs.withColumn("score", probability(F.col(text)))


def quality_labels(labels: DataFrame, modulus: int = 5) -> DataFrame:
    """Labels that may be learned from: rows outside the held-out fold."""
    return labels.where(fold(F.col("doc_id"), modulus) != 0).select("doc_id", F.col("quality").alias("label"))
