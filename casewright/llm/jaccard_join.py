"""Exact n-gram Jaccard self-join by partitioning the universe of shingles.

Texts of equal words are one class. Classes are banded by size, so that partners lie in the same or the next band, and
two linked sets of a band differ in at most ``h`` shingles. Shingles are hashed into more than ``h`` segments: linked
sets agree in one segment at least, whose content is their common key. Which segments a set indexes is chosen by cost:

* level 0, segments of two shingles or more (short contents are what unrelated texts share), if they are more than ``h``,
* level 1, all segments that aren't empty, if those are,
* level 2, these, and of each its contents with one shingle deleted, if their capacities (1 and 2) sum to more than ``h``,
* level 3, these, and the empty segments.

Each level holds the ones below, and the lower of two partners' levels finds the pair, so no link is lost. Keys that several
classes share are first resolved as stars: each class is verified against the one of its key that shares most. Only
between what is then still apart in a key are further pairs formed, if their sizes and a bound on their distance (counts of
shingles in 256 bins) allow a link; groups above ``split_members`` are keyed once more by an independent partition
before that, and what is still larger is compared block by block. Pairs are verified exactly on the whole texts. Components grow by rounds of smallest labels, each round written to the
shared folder; nothing but counts comes to the driver.

Candidates come from hashes; classes are told apart by 128-bit digests of their words, and every link is verified on the
shingles themselves. Classes are named by half of their digest; the few halves that different texts share (about n * n / 2 ** 65
of n classes) are found first, and these are named anew. A group's members pass a task as rows of 16 bytes, and only
cells of about ``split_members`` are held.

Defined results: null and blank texts have an empty set and link with nothing; rows with a null id have no links and a null
component; rows that repeat an id are one document if their texts are equal and linked through their id otherwise; an
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds, Scratch, materialize

BINS = 256


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    percent: int = 80
    split_members: int = 2000
    batch_bytes: int = 1 << 20
    remembered: int = 500_000  # classes whose keys a task doesn't give again
    most_odd: int = 100_000  # class halves that several sets share; about n * n / 2 ** 65 of n classes are to be expected


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of uint64 that spreads its bits."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    """The words of a text, with A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def chain_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each ``words`` neighbouring word hashes, in order."""
    state = np.full(max(0, len(hashes) - words + 1), words, dtype=np.uint64)
    for k in range(words):
        state = (state ^ hashes[k : k + len(state)]) * np.uint64(0x9FB21C651E98DF25)
        state ^= state >> np.uint64(32)
    return state


def shingle_sets(split: list[list[bytes]], words: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text (of ``split_words``) as ascending 64-bit hashes; blank texts have none."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(split)), dtype=np.uint64, count=sum(map(len, split)))
    chained = chain_words(hashes, words)
    out, begin = [], 0
    for row in split:
        n = len(row)
        if n >= words:
            own = np.sort(chained[begin : begin + n - words + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(chain_words(hashes[begin : begin + n], n) if n else np.zeros(0, dtype=np.uint64))
        begin += n
    return out


def text_digests(split: list[list[bytes]]) -> np.ndarray:
    """128 bits of each text's words in order (0 for blank texts), in two halves. Texts of one digest have one set."""
    return np.frombuffer(b"".join(hashlib.blake2b(b" ".join(row), digest_size=16).digest() if row else bytes(16) for row in split), dtype=np.uint64).reshape(-1, 2)


def fingerprint(digests: np.ndarray, odd: frozenset[int] = frozenset()) -> np.ndarray:
    """A class of each text: half of its digest, and for the halves in ``odd``, which several texts have, one of the whole digest."""
    out = digests[:, 0].copy()
    for k in np.flatnonzero(np.isin(out.view(np.int64), list(odd))) if odd else ():
        out[k] = mix(digests[k, :1] ^ mix(digests[k, 1:]))[0]
    return out


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in 256 bins, up to 255; the sum of two sketches' differences is at most the sets' distance."""
    return np.minimum(np.bincount((mix(s, 2) >> np.uint64(56)).astype(np.intp), minlength=BINS), 255).astype(np.uint8).tobytes()


@functools.lru_cache(maxsize=2)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending sizes that begin and end the bands; a set's larger partners are in its band or the next one."""
    first, last, at = [], [], 1
    while at < 1 << 40:
        first.append(at)
        last.append(at * 100 // percent)
        at = last[-1] + 1
    return np.array(first), np.array(last)


def signatures(sets: list[np.ndarray], params: JoinParams = JoinParams(), seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and for each the number of its set. Empty sets have none."""
    p, (first, last) = params.percent, bands(params.percent)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.intp)
    tokens = np.concatenate([sets[k] for k in full])
    sizes = np.array([len(sets[k]) for k in full])
    own = np.searchsorted(first, sizes, side="right") - 1
    place, content_of = mix(tokens, 3 + 2 * seed), mix(tokens, 4 + 2 * seed)
    keys, owners = [], []
    for ahead in (0, 1):
        band = own + ahead
        # of a pair of sizes a and b, 100 * common >= p * union means: distance <= (100 - p) * (a + b) / (100 + p)
        h = (100 - p) * (sizes + last[band]) // (100 + p)
        most = 2 * (100 - p) * last[band] // (100 + p)
        m = most + 2 + most // 12
        live = np.ones(len(sizes), dtype=bool) if not ahead else sizes * 100 // p >= first[band]
        base = np.concatenate([[0], np.cumsum(m)])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        segment = ((place >> np.uint64(32)) * m[doc].astype(np.uint64) >> np.uint64(32)).astype(np.intp) + base[doc]
        content = np.zeros(base[-1], dtype=np.uint64)
        np.add.at(content, segment, content_of)
        count = np.bincount(segment, minlength=base[-1])
        two, one = (np.add.reduceat((count >= k).astype(np.int64), base[:-1]) for k in (2, 1))
        level = np.select([two > h, one > h, one + two > h], [0, 1, 2], 3)
        of = np.repeat(np.arange(len(sizes)), m)
        chosen = live[of] & ((count >= 2) | (level[of] >= 1) & (count == 1) | (level[of] == 3) & (count == 0))
        salt = mix((np.arange(base[-1]) - base[of]).astype(np.uint64) << np.uint64(8) | band[of].astype(np.uint64), 5 + seed)
        keys.append(mix(content[chosen] ^ salt[chosen], 6))
        owners.append(of[chosen])
        cut = np.flatnonzero((level[doc] >= 2) & live[doc] & (count[segment] >= 2))
        keys.append(mix((content[segment[cut]] - content_of[cut]) ^ salt[segment[cut]], 6))
        owners.append(doc[cut])
    return np.concatenate(keys), np.array(full)[np.concatenate(owners)]


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common) and common > 0


def word_shingles(row: list[bytes], words: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(row[k:] for k in range(words)))) if len(row) >= words else {tuple(row)} if row else set()


def linked(a: list[bytes], b: list[bytes], words: int, percent: int) -> bool:
    """Whether two texts' shingles themselves reach the threshold."""
    x, y = word_shingles(a, words), word_shingles(b, words)
    common = len(x & y)
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def _portions(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Parts of the batches with texts of about ``most`` bytes."""
    for batch in batches:
        size = batch["text"].str.len().fillna(0).cumsum().to_numpy() // most
        begin = 0
        for end in [*(np.flatnonzero(np.diff(size)) + 1).tolist(), len(batch)]:
            yield batch.iloc[begin:end]
            begin = end


def classes(docs: DataFrame, text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """``doc_id``, the class by its two halves ``fp`` and ``rest`` (null for empty sets) and the set's size, for each row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _portions(batches, params.batch_bytes):
            split = [split_words(t) for t in part["text"].where(part["text"].notna(), None)]
            digests = text_digests(split)
            n = np.array([len(s) for s in shingle_sets(split, params.words)], dtype=np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"], "fp": digests[:, 0].view(np.int64), "rest": digests[:, 1].view(np.int64), "n_shingles": n})

    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", F.col(text).alias("text"))
    found = slim.mapInPandas(rows, f"doc_id {kind}, fp bigint, rest bigint, n_shingles bigint")
    return found.withColumns({c: F.when(F.col("n_shingles") > 0, F.col(c)) for c in ("fp", "rest")})


def odd_halves(of: DataFrame, params: JoinParams) -> frozenset[int]:
    """The first halves that different classes of the table share. There are next to none, and more than ``most_odd`` are an error."""
    shared = of.groupBy("fp").agg(F.min("rest").alias("low"), F.max("rest").alias("high")).where("low < high").select("fp").limit(params.most_odd + 1).collect()
    if len(shared) > params.most_odd:
        raise ValueError("more classes share half a digest than can be by chance")
    return frozenset(r["fp"] for r in shared)


def settled(of: DataFrame, odd: frozenset[int]) -> DataFrame:
    """``of`` with classes that hold equal texts alone (see ``fingerprint``)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = np.stack([batch[c].to_numpy(dtype=np.int64, na_value=0) for c in ("fp", "rest")], axis=1).view(np.uint64)
            yield batch.assign(fp=pd.array(fingerprint(digests, odd).view(np.int64), dtype="Int64")).drop(columns="rest")

    if not odd:
        return of.drop("rest")
    schema = ", ".join(f"{c} {t}" for c, t in of.dtypes if c != "rest")
    return of.mapInPandas(rows, schema).withColumn("fp", F.when(F.col("n_shingles") > 0, F.col("fp")))


def keyed(rows: DataFrame, params: JoinParams, odd: frozenset[int] = frozenset(), seed: int = 0, outer: bool = False) -> DataFrame:
    """``key`` and ``fp`` of the sets of ``rows`` (text; with ``outer``, keys are bound to the rows' own ``key``)."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes that gave their keys in this task already
        for part in _portions((b.to_pandas() for b in batches), params.batch_bytes):
            split = [split_words(t) for t in part["text"].where(part["text"].notna(), None)]
            fp = fingerprint(text_digests(split), odd)
            if not outer:  # a class needs its keys once
                _, once = np.unique(fp, return_index=True)
                if len(seen) > params.remembered:
                    seen.clear()
                once = [k for k, f in zip(once.tolist(), fp[once].tolist()) if f not in seen]
                split, fp = [split[k] for k in once], fp[once]
                seen.update(fp.tolist())
            key, owner = signatures(shingle_sets(split, params.words), params, seed)
            if outer:
                key = mix(key ^ mix(part["key"].to_numpy().view(np.uint64), 7)[owner], 8)
            for k in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)].view(np.int64)) for x in (key, fp[owner])], schema=schema)

    return rows.select(*["key"] * outer, "text").mapInArrow(emit, "key bigint, fp bigint")


def shared_keys(rows: DataFrame) -> DataFrame:
    """Distinct (key, fp) of the keys that several classes have. Sorted rows are compared with their neighbours, so a key's size doesn't matter."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, before = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in _then_none(batches):
            if batch is not None:
                key, fp = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((key, fp)))
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
            key, fp = key[fresh], fp[fresh]
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            with_next, with_last = np.append(same, False), np.append(before == key[0], same)
            stop = len(key) if batch is None else len(key) - 1  # the last row waits for its neighbour
            out = np.flatnonzero((with_next | with_last)[:stop])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(fp[out])], names=["key", "fp"])
            if stop:
                before = key[stop - 1]
            key, fp = key[stop:], fp[stop:]

    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(neighbours, "key bigint, fp bigint")


def _then_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def stars(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class with its key's hub: the class whose keys have the most members."""
    sized = shared.join(shared.groupBy("key").agg(F.count("*").alias("n")), "key")
    weight = sized.groupBy("fp").agg(F.sum("n").alias("weight"))
    hubs = sized.join(weight, "fp").groupBy("key").agg(F.max(F.struct("weight", "fp")).alias("hub")).select("key", F.col("hub.fp").alias("hub"))
    pairs = shared.join(hubs, "key").where("fp != hub")
    return pairs.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def verify(pairs: DataFrame, texts: DataFrame, params: JoinParams) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, by their hashes and then by the shingles themselves. Texts are joined to pairs, so that hot classes can be split by adaptive execution."""
    one = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                fps = dict(zip([*part["a"], *part["b"]], [*part["text_a"], *part["text_b"]]))
                split = {fp: split_words(t) for fp, t in fps.items()}
                sets = dict(zip(split, shingle_sets(list(split.values()), params.words)))
                good = [jaccard_at_least(sets[a], sets[b], params.percent) and linked(split[a], split[b], params.words, params.percent) for a, b in zip(part["a"], part["b"])]
                yield part.loc[good, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(verified, "a bigint, b bigint")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``fp`` and ``label``, the smallest fp of its component, for all ends of ``edges`` (a, b).

    In each round every node tells its neighbours the smallest label it knows, and labels follow their labels; paths so shorten
    by more than half. Rounds are written to the shared folder, and the one before goes.
    """
    both = scratch.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    rounds = Rounds(edges.sparkSession)
    labels = rounds.write(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = both.join(labels.select(F.col("fp").alias("b"), "label"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("heard"))
        # a label's own label: whoever hears of a smaller one also tells the node that was its label before
        nearer = labels.join(heard, "fp").select("fp", "label", F.least("label", "heard").alias("best"))
        told = nearer.where("best < label").select(F.col("label").alias("fp"), F.col("best").alias("told")).groupBy("fp").agg(F.min("told").alias("told"))
        hooked = nearer.join(told, "fp", "left").select("fp", "label", F.least("best", "told").alias("best"))
        jump = hooked.select(F.col("fp").alias("best"), F.col("best").alias("further"))
        now = rounds.write(hooked.join(jump, "best").select("fp", F.least("best", "further").alias("label"), (F.least("best", "further") < F.col("label")).alias("changed")))
        labels = now.select("fp", "label")
        if now.where("changed").isEmpty():
            scratch.paths += rounds.paths
            return labels


def apart(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, fp, label) of keys whose classes are in several components, of three classes or more (stars settled those of two)."""
    known = shared.join(labels, "fp", "left").select("key", "fp", F.coalesce("label", "fp").alias("label"))
    several = known.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 and low < high")
    return known.join(several.select("key", "n"), "key")


def blocks(rows: DataFrame, params: JoinParams) -> DataFrame:
    """Cells of at most about ``split_members`` rows that hold each pair of a key's rows (key, fp, label) once.

    A larger group is cut into blocks by its classes' hashes, and each two blocks are a cell; ``side`` tells a cell's blocks
    apart (within one block, all its rows). Only rows of the same cell and of different sides are to be compared.
    """
    sized = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")
    cuts = F.when(F.col("n") > params.split_members, F.ceil(2 * F.col("n") / params.split_members)).otherwise(1).cast("bigint")
    sized = sized.withColumn("cuts", cuts)
    own = sized.withColumn("own", F.pmod(F.xxhash64("fp"), "cuts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)))
    side = F.when(F.col("own") == F.col("other"), F.col("fp")).otherwise(F.col("own"))
    cell = F.when(F.col("cuts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return own.select(cell.alias("key"), "fp", "label", side.alias("side"))


def cross_pairs(rows: DataFrame, params: JoinParams) -> DataFrame:
    """Distinct pairs of one key but different labels and sides that sizes and sketches allow to link. ``rows``: key, fp, label, side, size, sketch."""
    p = params.percent

    def distinct(found: tuple[list, list]) -> pd.DataFrame:
        x, y = (np.concatenate(f) for f in found)
        return pd.DataFrame(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0), columns=["a", "b"])

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, found, n = None, ([], []), 0
        for batch in _then_none(batches):
            if batch is not None:
                held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if held is None or not len(held):
                continue
            cut = len(held) if batch is None else int(held["key"].searchsorted(held["key"].iloc[-1]))
            bounds = [0, *(np.flatnonzero(np.diff(held["key"].to_numpy()[:cut])) + 1).tolist(), cut]
            fp, label, side, size = (held[c].to_numpy() for c in ("fp", "label", "side", "size"))
            counts = np.frombuffer(b"".join(held["sketch"]), dtype=np.uint8).reshape(-1, BINS).astype(np.int16)
            for begin, end in zip(bounds, bounds[1:]):
                for i in range(begin, end - 1):
                    rest = slice(i + 1, end)
                    most = (100 - p) * (size[i] + size[rest]) // (100 + p)
                    j = np.flatnonzero((label[rest] != label[i]) & (side[rest] != side[i]) & (np.abs(size[i] - size[rest]) <= most))
                    if len(j):
                        near = j[np.abs(counts[j + (i + 1)] - counts[i]).sum(axis=1) <= most[j]] + (i + 1)
                        found[0].append(np.full(len(near), fp[i]))
                        found[1].append(fp[near])
                        n += len(near)
                if n >= 100_000:
                    yield distinct(found)
                    found, n = ([], []), 0
            held = held.iloc[cut:]
        if n:
            yield distinct(found)

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(pairs, "a bigint, b bigint").distinct()


def links(docs: DataFrame, of: DataFrame, scratch: Scratch, odd: frozenset[int] = frozenset(), text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """Verified links (a, b) between classes that connect whatever the threshold connects. ``of``: the classes of ``docs``."""
    shared = scratch.write(shared_keys(keyed(docs.where("doc_id is not null").select(F.col(text).alias("text")), params, odd)), "shared")
    needed = of.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size")).join(shared.select("fp").distinct(), "fp", "left_semi")
    # of rows that repeat an id, those with the class's own text are needed; its class is told by the text itself
    found = classes_with_text(docs.join(needed.select("doc_id"), "doc_id", "left_semi"), odd, text, params)
    texts = scratch.write(found.join(needed.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("text").alias("text")), "texts")
    first = scratch.write(verify(stars(shared), texts, params), "links")
    rows = apart(shared, components(first, scratch))
    small = rows.where(F.col("n") <= params.split_members).select("key", "fp", "label")
    large = rows.where(F.col("n") > params.split_members).select("key", "fp", "label")
    # large groups are keyed again by a second partition of the universe: what links there must share a key of it, too
    again = scratch.write(shared_keys(keyed(large.join(texts.select("fp", "text"), "fp"), params, odd, seed=1, outer=True)), "again").join(large.select("fp", "label").distinct(), "fp")
    todo = blocks(small.unionByName(again.select("key", "fp", "label")), params).join(texts.select("fp", "size", "sketch"), "fp")
    second = verify(cross_pairs(todo, params), texts, params)
    return first.unionByName(scratch.write(second, "links"))


def classes_with_text(docs: DataFrame, odd: frozenset[int], text: str, params: JoinParams) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _portions(batches, params.batch_bytes):
            split = [split_words(t) for t in part["text"]]
            sets = shingle_sets(split, params.words)
            yield pd.DataFrame({"fp": fingerprint(text_digests(split), odd).view(np.int64), "size": [len(s) for s in sets], "sketch": [sketch(s) for s in sets], "text": part["text"].to_numpy()})

    return docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(rows, "fp bigint, size bigint, sketch binary, text string").where("size > 0")


def jaccard_components(docs: DataFrame, text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row."""
    of = materialize(classes(docs, text, params), "classes")
    odd = odd_halves(of, params)
    of = settled(of, odd)
    ids = of.where("doc_id is not null and fp is not null")
    # an id whose rows have different texts links these, too
    repeated = ids.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").join(ids, "doc_id").where("fp != a").select("a", F.col("fp").alias("b"))
    scratch = Scratch(docs.sparkSession)
    labels = components(links(docs, of, scratch, odd, text, params).unionByName(repeated), scratch)
    smallest = ids.groupBy("fp").agg(F.min("doc_id").alias("low")).join(labels, "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    smallest = materialize(smallest, "smallest")
    scratch.clear()
    lowest = smallest.groupBy("label").agg(F.min("low").alias("component_id"))
    component = smallest.join(lowest, "label").select(F.col("fp").alias("__fp"), "component_id")
    out = of.join(component, F.col("fp") == F.col("__fp"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """One document of each component, that with the smallest id, with its columns. Rows without an id stay; of rows that repeat an id one stays."""
    kept = jaccard_components(docs, text, params).where("doc_id = component_id").select("doc_id").distinct()
    found = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    rest = [c for c in docs.columns if c != "doc_id"]
    whole = F.struct(*[F.col(c) for c in rest])
    one = found.groupBy("doc_id").agg(F.min_by(whole, F.xxhash64(*rest)).alias("__row")).select("doc_id", *[F.col(f"__row.{c}").alias(c) for c in rest])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))
