"""Divergence between the sources of each language, by the occurrences of their terms; a heavy-light split of the terms.

A group is a (language, source). Terms in ``least_docs`` documents of their language or more are kept (V of them). Each group, and each
language as a whole, gives every kept term ``p = 1 + (10^9 (count + 2)) div (N + 2 V)``, and two of them differ by the sum over all kept
terms of ``f(p, q) = (p - q)^2 div (p + q)``. All numbers are 64-bit integers.

A term that a group lacks has the group's one least value, ``p0``. So the sum of a pair is ``V f(p0, q0)`` plus what the terms that one of them has
add to it:

* light terms, in at most ``light_groups`` groups: a term that is only in one of the two depends on its count alone, so terms of equal count are
  counted (a histogram of each group); pairs of a term's posting list then get the difference that having it both makes. A list is
  bounded, and so are its pairs.
* heavy terms: dense numpy tiles of at most ``tile_groups`` times ``tile_groups`` groups and about ``tile_terms`` terms.

Tiles and histograms are grouped by (language, two blocks of groups, part of the terms), so that no task holds a language; partial sums of
a pair are added. Counts of terms are added up in each task before they are shuffled.

Defined results: null text, language and source are ''; a group or language without terms has its rows all the same, with 0 where V is 0; repeated rows count
each; an empty table gives an empty table. Numbers are exact for counts below 9 * 10^15.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize

#: ASCII letters (lower-cased) and all bytes of other characters stay; the rest separates terms.
TERM_BYTES = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
COUNTS = "grp bigint, term string, n bigint, docs bigint"
SUMS = "lang string, a int, b int, value bigint"


@dataclass(frozen=True)
class DivergenceParams:
    least_docs: int = 10
    top_terms: int = 10
    light_groups: int = 8
    tile_groups: int = 64
    tile_terms: int = 256
    tile_counts: int = 65_536  # rows of histograms
    pending: int = 3_000_000  # counts that a task holds before it adds them up
    held: int = 1_000_000  # different ones, or terms, that it holds before it gives them out


class Counter:
    """Occurrences and documents of (group, term) in a task."""

    def __init__(self, params: DivergenceParams):
        self.params = params
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, groups: np.ndarray, texts: list[bytes | None]) -> None:
        """``groups``: a number below 2^31 for each text."""
        ids, sizes = [], []
        for body in texts:
            tokens = body.translate(TERM_BYTES).split() if body else []
            ids.append(np.fromiter(map(self.numbers.__getitem__, tokens), dtype=np.int64, count=len(tokens)))
            sizes.append(len(tokens))
        keys, n = np.unique(np.repeat(np.arange(len(texts), dtype=np.int64) << 32, sizes) | np.concatenate([np.zeros(0, dtype=np.int64), *ids]), return_counts=True)
        keys = groups[keys >> 32] << 32 | keys & 0xFFFFFFFF
        self._hold([(keys, n, np.ones(len(keys), dtype=np.int64))])

    def _hold(self, more: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.parts += more
        self.pending = sum(len(p[0]) for p in self.parts)
        if self.pending >= self.params.pending:
            self.parts = [self.summed()]
            self.pending = len(self.parts[0][0])

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n, docs = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*self.parts) if self.parts else ((), (), ())))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[at], np.add.reduceat(n[order], at) if len(at) else n, np.add.reduceat(docs[order], at) if len(at) else docs

    @property
    def full(self) -> bool:
        return len(self.parts) == 1 and self.pending >= self.params.held or len(self.numbers) >= self.params.held

    def rows(self, groups: list[int], step: int = 200_000) -> Iterator[pd.DataFrame]:
        keys, n, docs = self.summed()
        terms = np.array([t.decode("utf-8", "replace") for t in self.numbers], dtype=object)
        of = np.array(groups, dtype=np.int64)
        for k in range(0, len(keys), step):
            part = keys[k : k + step]
            yield pd.DataFrame({"grp": of[part >> 32], "term": terms[part & 0xFFFFFFFF], "n": n[k : k + step], "docs": docs[k : k + step]})


def term_counts(docs: DataFrame, params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """``COUNTS`` of rows (grp, text as bytes), added up in each task and then over all."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, local, groups = Counter(params), {}, []
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.iloc[k : k + 1000]
                for g in part["grp"].unique().tolist():
                    if g not in local:
                        local[g] = len(groups)
                        groups.append(g)
                counter.add(np.array([local[g] for g in part["grp"].tolist()], dtype=np.int64), part["text"].tolist())
                if counter.full:
                    yield from counter.rows(groups)
                    counter.clear()
        yield from counter.rows(groups)

    return docs.mapInPandas(tally, COUNTS).groupBy("grp", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, kept: Column, terms: Column) -> Column:
    """``1 + (10^9 (n + 2)) div (kept + 2 terms)``, by long division with three digits of a thousand, so that no product overflows."""
    thousand, whole = F.lit(1000).cast("bigint"), kept + 2 * terms
    rest, out = n + 2, F.lit(0).cast("bigint")
    div = lambda a, b: F.call_function("div", a, b)
    for _ in range(3):
        rest = rest * thousand
        out = out * thousand + div(rest, whole)
        rest = rest % whole
    return F.when(whole > 0, out + 1).otherwise(F.lit(1).cast("bigint"))


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _column_gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _one_sided(rows: pd.DataFrame, own: pd.Series, other: np.ndarray) -> np.ndarray:
    """For each group of ``own`` (p0 by number) and each p0 of ``other``: what the terms of the group's histogram add if the other lacks them."""
    out = np.zeros((len(own), len(other)), dtype=np.int64)
    at = pd.Index(own.index).get_indexer(rows["idx"])
    used = at >= 0
    at, p, weight = at[used], rows["p"].to_numpy(np.int64)[used], rows["weight"].to_numpy(np.int64)[used]
    base = own.to_numpy(np.int64)
    for k in range(0, len(at), 4096):
        i, x = at[k : k + 4096], p[k : k + 4096, None]
        np.add.at(out, i, weight[k : k + 4096, None] * (gap(x, other[None, :]) - gap(base[i][:, None], other[None, :])))
    return out


def _dense(rows: pd.DataFrame, left: pd.Series, right: pd.Series) -> np.ndarray:
    """The sum of all differences over the tile's terms, less that of as many absent ones."""
    term, names = pd.factorize(rows["term"])

    def table(own: pd.Series) -> np.ndarray:
        out = np.repeat(own.to_numpy(np.int64)[:, None], len(names), axis=1)
        at = pd.Index(own.index).get_indexer(rows["idx"])
        used = at >= 0
        out[at[used], term[used]] = rows["p"].to_numpy(np.int64)[used]
        return out

    a, b = table(left), table(right)
    base = gap(left.to_numpy(np.int64)[:, None], right.to_numpy(np.int64)[None, :])
    return np.stack([gap(row[None, :], b).sum(axis=1) for row in a]) - base * len(names)


def tile(rows: pd.DataFrame) -> pd.DataFrame:
    """The partial sums of a tile (lang, i, j, part): rows without p are the groups of its two blocks; part 0 holds the base, it and those below 0 histograms, others heavy terms."""
    first = rows.iloc[0]
    groups = rows[rows["p"].isna()].drop_duplicates("idx").set_index("idx").sort_index()
    left, right = (groups.loc[groups["block"] == first[side], "p0"].astype(np.int64) for side in ("i", "j"))
    found = rows[rows["p"].notna()]
    sums = np.zeros((len(left), len(right)), dtype=np.int64)
    if first["part"] == 0:
        sums += int(first["terms"]) * gap(left.to_numpy()[:, None], right.to_numpy()[None, :])
    if first["part"] <= 0:
        sums += _one_sided(found, left, right.to_numpy()) + _one_sided(found, right, left.to_numpy()).T
    elif len(found):
        sums += _dense(found, left, right)
    a, b = np.meshgrid(left.index.to_numpy(), right.index.to_numpy(), indexing="ij")
    use = a < b
    return pd.DataFrame({"lang": first["lang"], "a": a[use], "b": b[use], "value": sums[use]})


def light_pairs(lists: DataFrame, params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """What pairs of groups that share a light term get for it, beyond what the histograms gave them. ``lists``: lang, list of (idx, p, p0)."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def summed() -> pd.DataFrame:
            return pd.concat(held).groupby(["lang", "a", "b"], as_index=False)["value"].sum()

        for batch in batches:
            sizes = batch["list"].map(len).to_numpy()
            for m in np.unique(sizes[sizes > 1]).tolist():
                part = batch[sizes == m]
                cells = np.array([[(x["idx"], x["p"], x["p0"]) for x in one] for one in part["list"]], dtype=np.int64)
                x, y = np.triu_indices(m, 1)
                a, b = cells[:, x], cells[:, y]
                value = gap(a[..., 1], b[..., 1]) - gap(a[..., 1], b[..., 2]) - gap(a[..., 2], b[..., 1]) + gap(a[..., 2], b[..., 2])
                low, high = np.minimum(a[..., 0], b[..., 0]), np.maximum(a[..., 0], b[..., 0])
                held.append(pd.DataFrame({"lang": np.repeat(part["lang"].to_numpy(), len(x)), "a": low.ravel(), "b": high.ravel(), "value": value.ravel()}))
            if sum(map(len, held)) >= params.held:
                held = [summed()]
                if len(held[0]) >= params.held // 2:
                    yield held.pop()
        if held:
            yield summed()

    return lists.mapInPandas(pairs, SUMS)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has each other source of the language, part ``term`` the terms that the group has more of than its language."""
    scratch = Scratch(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = docs.select(blank(text).cast("binary").alias("text"), blank(lang).alias("lang"), blank(source).alias("source"))
    named = slim.select("lang", "source").distinct().withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = scratch.write(named.withColumn("grp", F.monotonically_increasing_id()), "groups")
    counts = term_counts(slim.join(groups.select("lang", "source", "grp"), ["lang", "source"]).select("grp", "text"), params)
    one_term = Window.partitionBy("lang", "term")
    seen = counts.join(groups.select("grp", "lang", "idx"), "grp").withColumns({"all_docs": F.sum("docs").over(one_term), "n_groups": F.count("*").over(one_term), "lang_n": F.sum("n").over(one_term), "least": F.min("idx").over(one_term)})
    kept = scratch.write(seen.where(F.col("all_docs") >= params.least_docs).select("lang", "grp", "idx", "term", "n", "n_groups", "lang_n", (F.col("idx") == F.col("least")).alias("first")), "kept-terms")

    # V and N of languages, N of groups, and their least shares
    heavy = F.col("n_groups") > params.light_groups
    whole = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_kept"), F.count_if(F.col("first") & heavy).alias("heavy_terms"))
    hist = scratch.write(kept.where(~heavy).groupBy("lang", "grp", "n").agg(F.count("*").alias("weight")), "histograms")
    whole = whole.join(hist.groupBy("lang").agg(F.count("*").alias("hist_rows")), "lang", "left")
    own = kept.groupBy("grp").agg(F.sum("n").alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    size = F.count("*").over(Window.partitionBy("lang"))
    stats = groups.join(whole, "lang", "left").join(own, "grp", "left").select("lang", "source", "grp", "idx", *[zero(c) for c in ("terms", "lang_kept", "heavy_terms", "hist_rows", "kept")], size.alias("n_sources"))
    block = F.floor(F.col("idx") / params.tile_groups).cast("int")
    stats = stats.withColumns({"p0": share(F.lit(0).cast("bigint"), F.col("kept"), F.col("terms")), "block": block, "blocks": F.ceil(F.col("n_sources") / params.tile_groups).cast("int"), "parts": F.ceil(F.col("heavy_terms") / params.tile_terms).cast("int"), "hist_parts": F.greatest(F.lit(1), F.ceil(F.col("hist_rows") / params.tile_counts).cast("int"))})
    stats = scratch.write(stats, "group-stats")

    posted = kept.drop("lang", "idx").join(stats, "grp").withColumn("p", share(F.col("n"), F.col("kept"), F.col("terms")))
    light = posted.where(~heavy)
    none = lambda kind: F.lit(None).cast(kind)
    rows = ["lang", "part", "block", "blocks", "terms", "idx", "p0", "term", "p", "weight"]
    everywhere = stats.withColumn("part", F.explode(F.sequence(1 - F.col("hist_parts"), F.col("parts")))).withColumns({"term": none("string"), "p": none("bigint"), "weight": none("bigint")})
    dense = posted.where(heavy).withColumns({"part": (F.pmod(F.xxhash64("term"), F.col("parts")) + 1).cast("int"), "weight": none("bigint")})
    sparse = hist.drop("lang").join(stats, "grp").withColumns({"p": share(F.col("n"), F.col("kept"), F.col("terms")), "part": -F.pmod(F.xxhash64("n"), F.col("hist_parts")).cast("int"), "term": none("string")})
    tiles = everywhere.select(*rows).unionByName(dense.select(*rows)).unionByName(sparse.select(*rows))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = tiles.groupBy("lang", "i", "j", "part").applyInPandas(tile, SUMS)
    lists = light.where("n_groups > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("idx", "p", "p0")).alias("list")).select("lang", "list")  # at most light_groups
    sums = dealt.unionByName(light_pairs(lists, params)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.inline(F.array(F.struct(F.col("a").alias("idx"), F.col("b").alias("other")), F.struct(F.col("b").alias("idx"), F.col("a").alias("other")))))
    name = stats.select("lang", F.col("idx").alias("other"), F.col("source").alias("item"))
    pair = both.join(stats.select("lang", "idx", "source"), ["lang", "idx"]).join(name, ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    usual = share(F.col("lang_n"), F.col("lang_kept"), F.col("terms"))
    more = posted.withColumn("q", usual).where("p > q")
    term = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _column_gap(F.col("p"), F.col("q")).alias("value"))
    top = term.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= params.top_terms)
    out = materialize(pair.unionByName(top), "divergence")
    scratch.clear()
    return out
