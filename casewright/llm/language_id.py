"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of 0 to ``max_order`` bytes with the counts of the bytes that followed. A
byte's exact code length under a language starts at the longest context: a seen byte costs -log2(c / (n + q)), an unseen
one the escape -log2(q / (n + q)) and then its cost in the next shorter context, with 8 bits below order 0 (n: bytes
seen in the context, q: different ones). A context that the language never saw passes on for nothing. Statistics
are frozen; the language with the shortest code wins.

The trees are fitted on a bounded sample (``PpmParams.sample_docs`` documents for each language, those with the smallest
id hash, texts above ``sample_bytes`` left out); whole texts are scored. The model is sent to each task, and its size is checked:
more than ``most_langs`` languages or ``most_bytes`` bytes are an error.

Defined results: ``und`` with score 0 for null texts and texts without a letter, or where nothing could be learned; ties
go to the language that sorts first; rows with a null lang or id are not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 8  # of each byte in a packed key
MIX = np.uint64(0x9E3779B97F4A7C15)
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass(frozen=True)
class PpmParams:
    max_order: int = 4
    sample_docs: int = 400
    most_sample: int = 400_000_000  # bytes of all sampled texts; with many languages each gives fewer documents
    sample_bytes: int = 20_000  # so that a language's sample is 8 MB at most
    most_langs: int = 256
    most_bytes: int = 1 << 30  # of the tables that are sent to the tasks
    rank_parts: tuple[int, ...] = (512, 64, 8, 1)  # of each language, one step after the other
    chunk_bytes: int = 1 << 17  # scored at once


class KeyTable:
    """Positions of distinct uint64 keys, by open addressing; all steps work on whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.keys = np.append(keys, np.uint64(0)).astype(np.uint64)
        at, rest = self._first(keys), np.arange(len(keys), dtype=np.int32)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            lost = self.slots[at] != rest
            rest, at = rest[lost], (at[lost] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where it is missing."""
        at = self._first(keys)
        out = self.slots[at]
        ask = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(ask):
            at[ask] = (at[ask] + 1) & self.mask
            out[ask] = self.slots[at[ask]]
            ask = ask[(out[ask] >= 0) & (self.keys[out[ask]] != keys[ask])]
        return out


def _packed(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from position ``order`` on, the byte and the ``order`` ones before it, in one key."""
    n = len(data) - order
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(BITS)) | data[k : k + n]
    return out


class PpmModel:
    """Frozen trees of some languages: for each order, tables of code lengths (byte in context) and of escapes (context)."""

    def __init__(self, samples: dict[str, list[bytes]], params: PpmParams = PpmParams()):
        self.langs, self.params = sorted(samples), params
        self.grams: list[tuple[KeyTable, np.ndarray]] = []
        self.escapes: list[tuple[KeyTable, np.ndarray]] = []
        for order in range(params.max_order + 1):
            self._grow(order, [self._counts(samples[x], order) for x in self.langs])

    @staticmethod
    def _counts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [_packed(np.frombuffer(t, dtype=np.uint8).astype(np.uint64), order) for t in texts if len(t) > order]
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def _grow(self, order: int, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys = np.unique(np.concatenate([k for k, _ in counts])) if counts else np.zeros(0, np.uint64)
        parents = np.unique(keys >> np.uint64(BITS))
        cost = np.full((len(keys), len(self.langs)), np.nan, dtype=np.float64)
        escape = np.zeros((len(parents), len(self.langs)), dtype=np.float64)
        for j, (k, c) in enumerate(counts):
            if len(k):
                at = np.searchsorted(parents, k >> np.uint64(BITS))
                n, q = np.bincount(at, weights=c, minlength=len(parents)), np.bincount(at, minlength=len(parents))
                cost[np.searchsorted(keys, k), j] = -np.log2(c / (n[at] + q[at]))
                seen = q > 0
                escape[seen, j] = -np.log2(q[seen] / (n[seen] + q[seen]))
        # a byte that a language has not seen here costs the escape and its length in the shorter context
        below = self._lengths(keys & np.uint64((1 << (BITS * order)) - 1), order - 1) + escape[np.searchsorted(parents, keys >> np.uint64(BITS))]
        cost = np.where(np.isnan(cost), below, cost)
        self.grams.append((KeyTable(keys), cost.astype(np.float32)))
        self.escapes.append((KeyTable(parents), escape.astype(np.float32)))

    def _lengths(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths (keys x languages) of bytes in contexts of ``order`` bytes."""
        out = np.zeros((len(keys), len(self.langs)), dtype=np.float32)
        rest = np.arange(len(keys))
        while len(rest) and order >= 0:
            table, cost = self.grams[order]
            at = table.find(keys)
            hit = at >= 0
            out[rest[hit]] += cost[at[hit]]
            rest, keys = rest[~hit], keys[~hit]
            contexts, escape = self.escapes[order]
            at = contexts.find(keys >> np.uint64(BITS))
            seen = at >= 0
            out[rest[seen]] += escape[at[seen]]
            keys = keys & np.uint64((1 << (BITS * order)) - 1)
            order -= 1
        out[rest] += 8
        return out

    def _sums(self, keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code lengths of bytes in contexts of ``max_order`` bytes, summed over runs of keys that end at ``ends``."""
        out = np.zeros((len(ends), len(self.langs)))
        rest = np.arange(len(keys))

        def add(cost: np.ndarray, found: np.ndarray) -> None:
            bounds = np.searchsorted(rest[found], ends)
            full = np.flatnonzero(np.diff(bounds, prepend=0))
            if len(full):
                starts = np.concatenate([[0], bounds[full][:-1]])
                out[full] += np.add.reduceat(cost, starts, axis=0, dtype=np.float64)

        for order in range(self.params.max_order, -1, -1):
            for table, cost, ask in ((*self.grams[order], keys), (*self.escapes[order], None)):
                at = table.find(keys >> np.uint64(BITS) if ask is None else ask)
                found = at >= 0
                add(cost[at[found]], found)
                if ask is not None:
                    rest, keys = rest[~found], keys[~found]
            keys = keys & np.uint64((1 << (BITS * order)) - 1)
        left = np.searchsorted(rest, ends)
        return out + 8.0 * np.diff(left, prepend=0)[:, None]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language. The first bytes of a text have the shorter contexts that there are."""
        total = np.zeros((len(texts), len(self.langs)))
        top, step = self.params.max_order, self.params.chunk_bytes
        owners: list[int] = []
        pieces: list[np.ndarray] = []

        def flush() -> None:
            np.add.at(total, owners, self._sums(np.concatenate(pieces), np.cumsum([len(x) for x in pieces])))
            owners.clear()
            pieces.clear()

        heads = [np.frombuffer(raw[:top], dtype=np.uint8).astype(np.uint64) for raw in texts]
        for k in range(top):
            long = [i for i, h in enumerate(heads) if len(h) > k]
            if long:
                keys = np.array([_packed(heads[i][: k + 1], k)[0] for i in long], dtype=np.uint64)
                total[long] += self._lengths(keys, k)
        size = 0
        for i, raw in enumerate(texts):
            data = np.frombuffer(raw, dtype=np.uint8)
            for begin in range(0, len(data) - top, step):
                owners.append(i)
                pieces.append(_packed(data[begin : begin + step + top].astype(np.uint64), top))
                size += len(pieces[-1])
                if size >= step:
                    flush()
                    size = 0
        if pieces:
            flush()
        return total

    def size(self) -> int:
        """Bytes of all tables."""
        return sum(t.keys.nbytes + t.slots.nbytes + c.nbytes for t, c in [*self.grams, *self.escapes])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        best, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
        ask = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        if ask:
            bits = self.code_lengths([texts[i].encode("utf-8", "replace") for i in ask])
            at = bits.argmin(axis=1)
            sure[ask] = 1 / np.exp2(np.maximum(-1000, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
            for i, j in zip(ask, at):
                best[i] = self.langs[j]
        return best, sure


def learn(docs: DataFrame, params: PpmParams = PpmParams(), text: str = "text", lang: str = "lang") -> PpmModel:
    """Fit on rows of ``docs`` (doc_id, text, lang). The sample's ids are a bounded table, and only its texts come to the driver."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= params.sample_bytes))
    ids = known.select("doc_id", F.col(lang).alias("lang")).withColumn("mark", F.xxhash64("doc_id")).distinct()
    langs = ids.select("lang").distinct().limit(params.most_langs + 1).count()
    if langs > params.most_langs:
        raise ValueError(f"more than {params.most_langs} languages")
    # fewer documents of each where there are so many languages that the sample would outgrow the driver
    docs_each = max(1, min(params.sample_docs, params.most_sample // (max(langs, 1) * params.sample_bytes)))
    # the smallest of ever larger parts of a language, so that no task ranks a whole language
    for parts in params.rank_parts:
        order = Window.partitionBy("lang", "part").orderBy("mark", "doc_id")
        ids = ids.withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(parts))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_each).select("doc_id", "lang", "mark")
    ids = ids.select("doc_id", "lang")
    rows = known.select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").distinct().collect()
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "replace"))
    model = PpmModel(samples, params)
    if model.size() > params.most_bytes:
        raise ValueError("the model is too large to be sent to each task: lower sample_docs or max_order")
    return model


def identify(docs: DataFrame, model: PpmModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to each row. No shuffle; a batch of texts at a time."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, sure = sent.value.predict(texts.where(texts.notna(), None).tolist())
            yield pd.DataFrame({"lang": langs, "score": sure})

    return docs.withColumn("__best", best(F.col(text))).withColumn("lang_pred", F.col("__best.lang")).withColumn("score", F.col("__best.score")).drop("__best")
