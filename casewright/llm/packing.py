"""Order-preserving packing into sequences of a fixed number of tokens.

The documents of a partition form one stream of tokens in their order. Dynamic programming chooses where to cut it:
cutting at a document's end is free, at a sentence's end it costs a little, elsewhere more, and each sequence costs its
padding. For boundaries ``b`` the recurrence is ``f[j] = cut[j] + size - b[j] + min(f[i] + b[i])`` over the boundaries
at most ``size`` tokens before, so the minimum is kept in a monotone queue and each boundary enters and leaves it once.
Short sequences of a power of two, which would need no padding, are not sought: they would fill the packed tensor less.

The stream is handled in blocks of ``block_tokens``; what follows a block's last cut goes on in the next, so memory
doesn't depend on a partition's or a document's length. There is no shuffle; padding beyond the cuts' own is at most
one sequence in each partition.

Defined results: null and empty texts are the end token alone; ids that repeat or are null are kept as they are; each
row's tokens lie in exactly one piece each; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import word_bpe

PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@dataclass(frozen=True)
class PackParams:
    size: int = 2048
    sentence_cut: float = 1.0
    inner_cut: float = 4.0
    inner_step: int = 32  # inside longer sentences, cuts are possible after so many tokens
    block_tokens: int = 1 << 16
    end_id: int = 1


def choose_cuts(bounds: list[int], costs: list[float], params: PackParams = PackParams(), last: bool = True) -> list[int]:
    """The best ascending cuts for boundaries ``bounds`` (from 0, at most ``size`` apart) with a cost for cutting at each.

    If not ``last``, the end need not be a cut: the best one within ``size`` before it is the last.
    """
    size, n = params.size, len(bounds)
    best, back = [0.0] * n, [0] * n
    queue, keys, head = [0], [0.0], 0  # boundaries that can still be a sequence's start, by rising best[i] + bounds[i]
    for j in range(1, n):
        b = bounds[j]
        while bounds[queue[head]] < b - size:
            head += 1
        back[j] = queue[head]
        best[j] = value = keys[head] + size - b + costs[j]
        key = value + b
        while len(queue) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        queue.append(j)
        keys.append(key)
    j = n - 1
    if not last:
        # what is left over begins the next block's first sequence; its padding is then chosen there
        j = min(range(max(bisect_left(bounds, bounds[-1] - size), 1), n), key=lambda k: best[k] + bounds[-1] - bounds[k])
    cuts = []
    while j > 0:
        cuts.append(bounds[j])
        j = back[j]
    return cuts[::-1]


def _boundaries(starts: np.ndarray, ids: np.ndarray, sentence_ends: np.ndarray, params: PackParams) -> tuple[list[int], list[float]]:
    """Boundaries of a block with their costs. ``starts``: where documents begin in it."""
    total = len(ids)
    cost = np.full(total + 1, np.inf)
    cost[np.flatnonzero(sentence_ends[ids]) + 1] = params.sentence_cut
    cost[starts] = 0.0
    cost[[0, total]] = 0.0
    at = np.flatnonzero(np.isfinite(cost))
    for k in np.flatnonzero(np.diff(at) > params.inner_step).tolist():
        cost[at[k] + params.inner_step : at[k + 1] : params.inner_step] = params.inner_cut
    at = np.flatnonzero(np.isfinite(cost))
    return at.tolist(), cost[at].tolist()


class Packer:
    """Packs one stream; ``add`` and ``finish`` yield pieces (document's row, start, ids, tokens, sequence, offset)."""

    def __init__(self, sentence_ends: np.ndarray, params: PackParams = PackParams()):
        self.params, self.ends = params, sentence_ends
        self.docs: list[tuple[object, int, np.ndarray, int]] = []  # document, start in it, ids from there, its tokens
        self.held = 0
        self.sequence = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        step = self.params.block_tokens
        for start in range(0, len(ids), step):
            self.docs.append((doc, start, ids[start : start + step], len(ids)))
            self.held += len(self.docs[-1][2])
            if self.held >= step:
                yield from self._pack(last=False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._pack(last=True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        ids = np.concatenate([d[2] for d in self.docs])
        at = np.cumsum([0, *(len(d[2]) for d in self.docs)])
        whole = at[:-1][[d[1] == 0 for d in self.docs]]
        cuts = choose_cuts(*_boundaries(whole, ids, self.ends, self.params), self.params, last)
        begin, k = 0, 0
        for cut in cuts:
            place = begin
            while place < cut:
                doc, start, part, tokens = self.docs[k]
                stop = min(cut, int(at[k + 1]))
                yield doc, start + place - int(at[k]), ids[place:stop], tokens, self.sequence, place - begin
                place = stop
                if stop == at[k + 1]:
                    k += 1
            self.sequence += 1
            begin = cut
        rest = self.docs[k:]
        if rest:
            doc, start, part, tokens = rest[0]
            skip = begin - int(at[k])
            rest[0] = (doc, start + skip, part[skip:], tokens)
        self.docs, self.held = rest, len(ids) - begin


def pack(docs: DataFrame, tokenizer: str, text: str = "text", with_ids: bool = False, params: PackParams = PackParams(), encoder: Callable = word_bpe) -> DataFrame:
    """Pieces of packed sequences (``PIECE_SCHEMA``; ``ids`` too if asked for), packed partition by partition."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(tokenizer)
        packer = Packer(bpe.sentence_ends, params)
        base = TaskContext.get().partitionId() << 33
        end = np.array([params.end_id], dtype="<u4")
        columns = [c.split()[0] for c in PIECE_SCHEMA.split(", ")] + ["ids"] * with_ids

        def row(doc: object, start: int, ids: np.ndarray, tokens: int, sequence: int, offset: int) -> tuple:
            plain = (doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, base + sequence, offset)
            return (*plain, ids.astype("int32")) if with_ids else plain

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

        out = []
        for batch in batches:
            for doc, t in zip(batch["doc_id"], batch["text"]):
                ids = np.concatenate([bpe.encode(t) if t else end[:0], end])
                out += [row(*p) for p in packer.add(None if pd.isna(doc) else int(doc), ids)]
                if len(out) >= 4096:
                    yield frame(out)
                    out = []
        out += [row(*p) for p in packer.finish()]
        if out:
            yield frame(out)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInPandas(pieces, PIECE_SCHEMA + ", ids array<int>" * with_ids)
