"""Ranked lexical search by MaxScore in each shard of an index.

``build_index`` cuts the documents of each scan partition into blocks (shards) of a bounded number of documents and postings, one row
each: document ids, lengths, and for each term the documents that hold it with its occurrences. Nothing is shuffled. With ``terms``, only
postings of these are kept; counts are always those of whole texts.

``search`` takes the index's statistics (documents, occurrences, documents of each query term) and goes through the blocks. In a block, a
term's upper bound is its greatest weighted score there. A query's terms are ordered by their bounds; the longest tail of them whose
bounds sum to less than the score to beat is non-essential: a document with these alone can't qualify. Scores of the essential terms'
documents are added up, then the other postings are probed for documents whose score so far and remaining bounds still reach the
score to beat. That is the k-th best score of the task so far, blocks before this one included. The best k of each task are merged.

Scores are 64-bit integers: a term's weight ``w`` is ``floor(1000 ln((2N + 2) / (2 df + 1)))``, its part of a score ``w * ((10^9 tf) div
(1000 tf + 8 m))`` with ``m = 10 + (90 n N) div L``.

Queries are read in blocks of at most ``query_block`` rows or ``query_bytes`` of text, each of which goes through the whole index; only one
block of them is on the driver at a time.

Defined results: null and text without a term match nothing and count nowhere, as do queries without a term; each row of the queries is a
query of its own, also where ids repeat; repeated documents each have their rank; equal scores are ordered by id, a null id last; an empty
table on either side gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

INDEX_SCHEMA = "n_docs bigint, n_tokens bigint, doc_ids binary, no_id binary, lengths binary, terms array<string>, counts array<int>, docs binary, tfs binary"
#: ASCII letters (lower-cased) and digits, and all bytes of other characters, stay; the rest separates terms.
TERM_BYTES = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
NO_ID = np.iinfo(np.int64).max
SCALE = 1_000_000_000


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    block_docs: int = 16_384
    block_postings: int = 1_000_000
    query_block: int = 4_096
    query_bytes: int = 4 << 20
    most_terms: int = 1_000_000  # of all queries; above it the index holds all terms


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(TERM_BYTES).split()


def _block(ids: list, lengths: list[int], found: list[np.ndarray], words: list[str]) -> dict:
    """An index row of documents with their term numbers (one number for each occurrence of a kept term)."""
    sizes = np.array([len(x) for x in found], dtype=np.int64)
    keys = np.repeat(np.arange(len(found), dtype=np.int64), sizes)
    keys = np.concatenate([np.zeros(0, dtype=np.int64), *found]) * len(found) + keys
    keys, tfs = np.unique(keys, return_counts=True)
    numbers, counts = np.unique(keys // max(len(found), 1), return_counts=True)
    missing = np.array([i is None for i in ids], dtype=np.uint8)
    return {
        "n_docs": sum(n > 0 for n in lengths),
        "n_tokens": sum(lengths),
        "doc_ids": np.array([NO_ID if i is None else i for i in ids], dtype="<i8").tobytes(),
        "no_id": missing.tobytes() if missing.any() else b"",
        "lengths": np.array(lengths, dtype="<i8").tobytes(),
        "terms": [words[n] for n in numbers.tolist()],
        "counts": counts.astype(np.int32),
        "docs": (keys % max(len(found), 1)).astype("<u4").tobytes(),
        "tfs": tfs.astype("<u4").tobytes(),
    }


def build_index(docs: DataFrame, terms: list[str] | None = None, text: str = "text", params: SearchParams = SearchParams()) -> DataFrame:
    """Index rows (``INDEX_SCHEMA``); write them before several reads."""
    kept = None if terms is None else sorted(terms)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None if kept is None else {w.encode(): n for n, w in enumerate(kept)}
        ids: list = []
        lengths: list[int] = []
        found: list[np.ndarray] = []
        numbers: dict[bytes, int] = {}
        postings = 0

        def row() -> pd.DataFrame:
            words = kept if kept is not None else [w.decode() for w in numbers]
            return pd.DataFrame([_block(ids, lengths, found, words)])

        for batch in batches:
            for doc, gone, body in zip(batch["doc_id"].tolist(), batch["gone"].tolist(), batch["text"]):
                tokens = terms_of(body) if body else []
                if known is not None:
                    at = np.fromiter(map(known.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
                    at = at[at >= 0]
                else:
                    for t in tokens:
                        numbers.setdefault(t, len(numbers))
                    at = np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int64, count=len(tokens))
                ids.append(None if gone else doc)
                lengths.append(len(tokens))
                found.append(at)
                postings += len(at)
                if len(ids) >= params.block_docs or postings >= params.block_postings:
                    yield row()
                    ids, lengths, found, numbers, postings = [], [], [], {}, 0
        if ids:
            yield row()

    doc = F.col("doc_id").cast("bigint")
    slim = docs.select(F.coalesce(doc, F.lit(0).cast("bigint")).alias("doc_id"), doc.isNull().alias("gone"), F.col(text).cast("string").cast("binary").alias("text"))
    return slim.mapInPandas(blocks, INDEX_SCHEMA)


class Shard:
    """A block of the index with the scores of its postings under the collection's statistics."""

    def __init__(self, row: object, n: int, total: int):
        ids = np.frombuffer(row.doc_ids, dtype="<i8")
        missing = np.frombuffer(row.no_id, dtype=np.uint8).astype(bool) if row.no_id else np.zeros(len(ids), dtype=bool)
        order = np.lexsort([ids, missing])  # by id, so that documents that tie are found in the order of their ranks
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.missing, self.place = ids[order], missing[order], place
        lengths = np.frombuffer(row.lengths, dtype="<i8")
        if len(lengths) and int(lengths.max()) * 90 * n >= 1 << 63:
            self.m = np.array([10 + 90 * x * n // total for x in lengths.tolist()], dtype=np.int64)
        else:
            self.m = 10 + 90 * lengths * n // max(total, 1)
        ends = np.cumsum(np.asarray(row.counts, dtype=np.int64))
        self.at = {t: (int(e - c), int(e)) for t, e, c in zip(row.terms, ends.tolist(), row.counts)}
        self.docs, self.tfs = np.frombuffer(row.docs, dtype="<u4"), np.frombuffer(row.tfs, dtype="<u4")
        self.known: dict[str, tuple[np.ndarray, np.ndarray, int] | None] = {}
        self.sums = np.zeros(len(ids), dtype=np.int64)

    def postings(self, term: str, weight: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Documents in order, their parts of the score, and the greatest of these; None if the term adds nothing here."""
        if term not in self.known:
            place = self.at.get(term)
            found = None
            if place and weight > 0:
                docs, tf = self.docs[slice(*place)].astype(np.int64), self.tfs[slice(*place)].astype(np.int64)
                scores = weight * (SCALE * tf // (1000 * tf + 8 * self.m[docs]))
                docs = self.place[docs]
                order = np.argsort(docs)
                found = (docs[order], scores[order], int(scores.max()))
            self.known[term] = found
        return self.known[term]


def max_score(shard: Shard, terms: list[tuple[str, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard (places) that may be among the ``k`` best with a score of ``least`` or more, and their scores."""
    lists = sorted((p for p in (shard.postings(t, w) for t, w in terms) if p), key=lambda p: -p[2])
    rest = [0] * (len(lists) + 1)  # the sum of the bounds from each list on
    for i in range(len(lists) - 1, -1, -1):
        rest[i] = rest[i + 1] + lists[i][2]
    beat = max(least, 1)
    essential = len(lists)
    while essential and rest[essential - 1] < beat:
        essential -= 1
    sums, i, seen = shard.sums, 0, []
    while i < essential:
        docs, scores, _ = lists[i]
        sums[docs] += scores
        seen.append(docs)
        i += 1
        if i < essential and len(docs) >= k:
            # the k-th best sum so far is a score that k documents reach
            beat = max(beat, int(np.partition(sums[docs], len(docs) - k)[len(docs) - k]))
            while essential > i and rest[essential - 1] < beat:
                essential -= 1
    if not seen:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found = np.unique(np.concatenate(seen)) if len(seen) > 1 else seen[0]
    scores = sums[found]
    sums[found] = 0
    for j in range(essential, len(lists)):
        if len(scores) > k:
            beat = max(beat, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        can = scores + rest[j] >= beat
        found, scores = found[can], scores[can]
        docs, parts, _ = lists[j]
        at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
        scores = scores + np.where(docs[at] == found, parts[at], 0)
    can = scores >= beat
    return found[can], scores[can]


class Best:
    """The ``k`` best of a query in a task: by score, then id."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.scores = self.ids = np.zeros(0, dtype=np.int64)
        self.missing = np.zeros(0, dtype=bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids, missing = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.missing, missing)))
        order = np.lexsort([ids, missing, -scores])[: self.k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _search(index: DataFrame, queries: list[list[str]], statistics: tuple[int, int], params: SearchParams) -> DataFrame:
    """``query`` (number), doc_id, score: the best of each task."""
    n, total = statistics
    wanted = index.sparkSession.createDataFrame([(t,) for t in sorted(set(chain.from_iterable(queries)))], "term string")
    each = index.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("df"))
    weights = {r.term: weight(n, r.df) for r in each.join(wanted, "term", "left_semi").collect()}  # a query block's terms at most
    asked = [[(t, weights[t]) for t in q if t in weights] for q in queries]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(params.k) for _ in asked]
        for batch in batches:
            for row in batch.itertuples():
                shard = Shard(row, n, total)
                for terms, kept in zip(asked, best):
                    places, scores = max_score(shard, terms, params.k, kept.least)
                    if len(places):
                        kept.add(scores, shard.ids[places], shard.missing[places])
        for q, kept in enumerate(best):
            ids = pd.array(kept.ids, dtype="Int64")
            ids[kept.missing] = pd.NA
            yield pd.DataFrame({"query": q, "doc_id": ids, "score": kept.scores})

    return index.mapInPandas(run, "query bigint, doc_id bigint, score bigint")


def _query_blocks(queries: DataFrame, item: str, text: str, params: SearchParams) -> Iterator[tuple[list, list[list[str]]]]:
    """Item ids and distinct terms of the queries, block by block."""
    ids: list = []
    asked: list[list[str]] = []
    size = 0
    for row in queries.select(F.col(item).alias("item"), F.col(text).alias("body")).toLocalIterator():
        ids.append(row.item)
        asked.append([t.decode() for t in dict.fromkeys(terms_of((row.body or "").encode()))])
        size += len(row.body or "")
        if len(ids) >= params.query_block or size >= params.query_bytes:
            yield ids, asked
            ids, asked, size = [], [], 0
    if ids:
        yield ids, asked


def query_terms(queries: DataFrame, text: str = "text", params: SearchParams = SearchParams()) -> list[str] | None:
    """The terms of all queries, or None if they are more than ``most_terms``."""
    found: set[str] = set()
    for _, asked in _query_blocks(queries, text, text, params):
        found.update(chain.from_iterable(asked))
        if len(found) > params.most_terms:
            return None
    return sorted(found)


def search(index: DataFrame, queries: DataFrame, item: str = "item_id", text: str = "text", params: SearchParams = SearchParams()) -> DataFrame:
    """``item``, rank, doc_id, score: the ``k`` best documents of each query with a score above 0. ``index``: a written table."""
    spark = index.sparkSession
    kind = dict(queries.dtypes)[item]
    total = index.agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    statistics = (total[0] or 0, total[1] or 0)
    parts = []
    for ids, asked in _query_blocks(queries, item, text, params):
        found = _search(index, asked, statistics, params)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.k)
        names = spark.createDataFrame(list(enumerate(ids)), f"query bigint, item {kind}")
        parts.append(materialize(ranked.join(names, "query").select("item", "rank", "doc_id", "score"), "ranked"))
    empty = spark.createDataFrame([], f"item {kind}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, parts or [empty]).withColumnRenamed("item", item)


def rank_documents(docs: DataFrame, queries: DataFrame, item: str = "item_id", text: str = "text", params: SearchParams = SearchParams()) -> DataFrame:
    """Index ``docs`` for the terms of ``queries``, and search."""
    index = materialize(build_index(docs.select("doc_id", text), query_terms(queries, text, params), text, params), "lexical-index")
    return search(index, queries, item, text, params)
