"""Substring deduplication by line and sentence hashes.

A document's units are its lines, and the sentences of lines with several. Units are normalised (lower case, runs of
white space as one blank), digested to 128 bits and grouped over the whole corpus. Of each digest the earliest
occurrence stays, ranked by document id and then by place; all later ones go from their texts, within a document too.
Lines of fewer than ``min_line_words`` and sentences of fewer than ``min_sentence_words`` words are no units of their
own, as such short ones coincide by chance. With ``passages`` they count together with their neighbours: the shortest
groups of consecutive sentences of a line that begin or end with a short one and have ``min_sentence_words`` words are
units too, and such groups of consecutive short lines, so that a passage of short sentences goes group by group; and scripts without
blanks have their own sentence marks and count two characters as a word. Of what repeats, only runs of neighbouring units with
``min_run_words`` words together go: a single common line or sentence is no passage.

Removed spans keep their offsets in the original text (code points, the line's end mark included) and the document
that keeps the unit. A line that goes as a whole is one span.

Defined results: null texts stay null and have no unit, empty texts stay empty; documents with a null id rank last; rows
that repeat both id and text have the same ranks, so all of them keep or lose the same units; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize

SENTENCE = re.compile(r".*?[.!?]+[ \t\x0b\x0c\r]+|.+$")
#: With the marks of scripts that put no blank after them.
ANY_SENTENCE = re.compile(r".*?(?:(?<![.!?])[.!?]+[ \t\x0b\x0c\r]+|[。！？｡।॥؟۔።។]+[」』”’）]*[ \t\x0b\x0c\r]*)|.+$")
#: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
NO_BLANKS = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
UNIT_SCHEMA = "doc_id bigint, text_hash bigint, start int, length int, h1 bigint, h2 bigint"
SPANS = "array<struct<start:int,length:int,kept_in:bigint>>"


@dataclass(frozen=True)
class DedupParams:
    min_line_words: int = 4
    min_sentence_words: int = 8
    min_run_words: int = 16
    passages: bool = True


def split_words(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+``, lower-cased, in UTF-8."""
    return text.lower().encode("utf-8", "replace").split()


def n_words(words: list[bytes]) -> int:
    """Words, with each two characters of scripts without blanks as one."""
    return sum(max(1, len(NO_BLANKS.findall(w.decode())) // 2) for w in words)


def counter(text: str, params: DedupParams) -> Callable[[list[bytes]], int]:
    return n_words if params.passages and NO_BLANKS.search(text) else len


def groups(parts: list[tuple[int, int, int]], short: int, least: int) -> set[tuple[int, int]]:
    """First and last of the shortest groups of ``least`` words that begin with a part of fewer than ``short``; and those that end with one where none of the former does."""
    parts = [(n, k) for k, (_, _, n) in enumerate(parts) if n]
    found, ends, j, total = [], set(), 0, 0
    for i, (n, k) in enumerate(parts):
        while j < len(parts) and total < least:
            total += parts[j][0]
            j += 1
        if total >= least and n < short and j - i > 1:
            found.append((k, parts[j - 1][1]))
            ends.add(j - 1)
        total -= n
    i = total = 0
    for j, (n, k) in enumerate(parts):
        total += n
        while total - parts[i][0] >= least:
            total -= parts[i][0]
            i += 1
        if total >= least and n < short and j > i and j not in ends:
            found.append((parts[i][1], k))
    return set(found)


def passages(text: str, params: DedupParams) -> Iterator[tuple[int, int, bool, bytes]]:
    """``units`` and the groups of short sentences and lines."""
    count = counter(text, params)
    start, lines = 0, []
    for line in text.split("\n"):
        words = split_words(line)
        n, end = count(words), min(start + len(line) + 1, len(text))
        lines.append((start, end, n))
        if n >= params.min_line_words:
            yield start, end - start, True, b" ".join(words)
        found = list(ANY_SENTENCE.finditer(line)) if n >= params.min_sentence_words else []
        if len(found) > 1:
            inner = [split_words(m[0]) for m in found]
            parts = [(start + m.start(), start + m.end(), count(w)) for m, w in zip(found, inner)]
            for (begin, stop, k), w in zip(parts, inner):
                if k >= params.min_sentence_words:
                    yield begin, stop - begin, False, b" ".join(w)
            for a, b in groups(parts, params.min_sentence_words, params.min_sentence_words):
                if (a, b) != (0, len(parts) - 1):
                    yield parts[a][0], parts[b][1] - parts[a][0], False, b" ".join(w for x in inner[a : b + 1] for w in x)
        start += len(line) + 1
    for below, run in itertools.groupby(lines, lambda x: x[2] < params.min_line_words):
        run = list(run) if below else []
        for a, b in groups(run, params.min_line_words, params.min_sentence_words):
            yield run[a][0], run[b][1] - run[a][0], True, b" ".join(split_words(text[run[a][0] : run[b][1]]))


def units(text: str, params: DedupParams = DedupParams()) -> Iterator[tuple[int, int, bool, bytes]]:
    """``(start, length, whole lines, normalised unit)`` of each unit that counts."""
    if params.passages:
        yield from passages(text, params)
        return
    start = 0
    for line in text.split("\n"):
        plain = split_words(line)
        if len(plain) >= params.min_line_words:
            yield start, len(line) + (start + len(line) < len(text)), True, b" ".join(plain)
        if len(plain) >= params.min_sentence_words:
            found = list(SENTENCE.finditer(line))
            for m in found if len(found) > 1 else ():
                inner = split_words(m[0])
                if len(inner) >= params.min_sentence_words:
                    yield start + m.start(), len(m[0]), False, b" ".join(inner)
        start += len(line) + 1


def unit_table(docs: DataFrame, text: str = "text", params: DedupParams = DedupParams()) -> DataFrame:
    """The units of all documents with their digests (``UNIT_SCHEMA``)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        columns = [c.split()[0] for c in UNIT_SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for doc, key, t in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
                doc = None if pd.isna(doc) else int(doc)
                for start, length, _, plain in units(t, params):
                    d = xxhash.xxh3_128_intdigest(plain)
                    out.append((doc, key, start, length, signed(d >> 64), signed(d & ((1 << 64) - 1))))
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    slim = docs.where(F.col(text).isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return slim.mapInPandas(rows, UNIT_SCHEMA)


def join_counted(found: DataFrame, digests: DataFrame, on: list[str], total: int, share: int = 1000) -> DataFrame:
    """``found`` with the columns of ``digests`` (a row each, with its number ``n`` of the ``total`` rows of ``found``).

    Digests of more than a ``share``-th of all rows, which can be ``share`` at most, are broadcast, so that no task gets all rows of one; the
    others are joined by their digest.
    """
    often = F.col("n") * share > total
    hot, rest = F.broadcast(digests.where(often)), digests.where(~often)
    return found.join(hot, on).unionByName(found.join(hot.select(*on), on, "left_anti").join(rest, on))


def repeated(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Units whose digest may occur again, by its first half. Counts combine before the shuffle."""
    often = scratch.write(found.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1"), "often")
    return join_counted(found, often, ["h1"], found.count()).drop("n")


def removals(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Units that are not the earliest of their digest and don't overlap it, with the document that keeps it. Earliest ranks combine before the shuffle."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), F.col("text_hash").alias("row"), F.col("start").alias("place"))
    first = scratch.write(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(rank).alias("first"), F.min_by("length", rank).alias("size")).where("n > 1"), "first")
    within = F.col("doc_id").eqNullSafe(F.col("first.doc")) & (F.col("text_hash") == F.col("first.row")) & (F.col("start") < F.col("first.place") + F.col("size"))
    later = join_counted(found, first, ["h1", "h2"], found.count()).where((rank != F.col("first")) & ~within)
    return later.select("doc_id", "text_hash", "start", "length", F.col("first.doc").alias("kept_in"))


def _outer(text: str, spans: list, params: DedupParams) -> list[tuple[int, int, int]]:
    """Spans in order, without those inside a removed line; of groups that overlap, each has what the ones before left. Runs of too few words stay."""
    out, end, count = [], 0, counter(text, params)
    for s in sorted(spans, key=lambda s: (s["start"], -s["length"])):
        start, stop = max(s["start"], end), s["start"] + s["length"]
        if stop > start:
            out.append((start, stop - start, s["kept_in"]))
            end = stop
    kept: list[tuple[int, int, int]] = []
    begin = 0
    for k in range(1, len(out) + 1):
        if k == len(out) or out[k][0] != out[k - 1][0] + out[k - 1][1]:
            if count(split_words(text[out[begin][0] : out[k - 1][0] + out[k - 1][1]])) >= params.min_run_words:
                kept += out[begin:k]
            begin = k
    return kept


def dedup_lines(docs: DataFrame, text: str = "text", params: DedupParams = DedupParams()) -> DataFrame:
    """Each document with its remaining ``text`` and the ``removed`` spans of its original text (null text: none)."""
    names = [c for c in docs.columns if c != "removed"]
    scratch = Scratch(docs.sparkSession)
    again = scratch.write(repeated(scratch.write(unit_table(docs, text, params), "units"), scratch), "repeated")
    gone = materialize(removals(again, scratch), "removals")
    scratch.clear()
    by_doc = gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length", "kept_in")).alias("__spans"))

    @F.pandas_udf(f"text string, removed {SPANS}")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        left, removed = [], []
        for t, found in zip(texts, spans):
            kept = _outer(t, found, params) if found is not None else []
            at, parts = 0, []
            for start, length, _ in kept:
                parts.append(t[at:start])
                at = start + length
            left.append(t if t is None or not kept else "".join(parts) + t[at:])
            removed.append([{"start": s, "length": n, "kept_in": k} for s, n, k in kept])
        return pd.DataFrame({"text": left, "removed": removed})

    keyed = docs.select(*names).withColumn("__hash", F.xxhash64(text)).alias("d")
    # a null id is stood for by 0 and told apart by a flag, so that the join has plain equal keys
    side = by_doc.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("text_hash").alias("__hash"), "__spans")
    joined = keyed.withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))).withColumn("__none", F.col("doc_id").isNull()).join(side, ["__id", "__none", "__hash"], "left")
    out = joined.withColumn("__cut", cut(F.col(text), F.col("__spans")))
    return out.select(*[F.col("__cut.text").alias(c) if c == text else F.col(c) for c in names], F.col("__cut.removed").alias("removed"))
