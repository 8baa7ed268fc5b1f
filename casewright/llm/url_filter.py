"""URL filtering by explicit rules and by mined association rules.

Spark's FP-growth mines combinations of URL tokens that imply a bad label. Rules are pruned by support (a share of the labelled
rows, and ``min_rows`` bad ones at least), by confidence (its value, and the lower end of its interval, which must lie above the
share of bad labels), and by implication (a longer rule goes where a shorter one says the same). They are matched through an
inverted index: each rule stands under the rarest of its tokens, URLs look up their tokens there, and only rules found so are
checked in full. Mining and matching look at all tokens of a URL: those of the very same labelled URLs count as one, and where a URL
still has more than ``mined_tokens`` of them, rules are mined level by level without sets that a shorter one implies, which FP-growth would have exponentially many of.

Defined results: a null url or one without ``://`` has an empty host and path, fits no explicit rule and is allowed;
repeated rows are judged alike; without labels no rule is mined; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rounds, Scratch, materialize

BAD = "label:bad"


@dataclass(frozen=True)
class MiningParams:
    min_support: float = 0.002
    min_confidence: float = 0.5
    min_rows: int = 5  # bad labelled rows behind a rule
    interval: float = 1.96  # standard deviations from a rule's confidence to the lower end of its interval (Wilson)
    mined_tokens: int = 12  # of a labelled URL by FP-growth; see mine_all_rules for URLs of more
    salts: int = 32  # parts that pages of one token set are dealt to


#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return pages.withColumn("__rest", rest).withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)).drop("__rest")


def document_id(path: Column) -> Column:
    """The last numeric part of a path (an ending such as ``.html`` aside), which is the id of the page's document; null where there is none."""
    return F.regexp_extract(path, r"(?s)^(?:.*/)?([0-9]+)(?:\.[A-Za-z][A-Za-z0-9]*)?(?:/.*)?$", 1).try_cast("bigint")


def labelled_urls(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """``(url, bad)`` of the pages whose document has a label. ``labels``: rows of (doc_id, bad boolean)."""
    known = split_url(pages.select(F.col(url).alias("url"))).select("url", document_id(F.col("path")).alias("doc_id"))
    return known.join(labels.select("doc_id", "bad"), "doc_id").select("url", "bad")


def explicit_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; null where none fits. Rules are a short configured list."""
    best = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(best):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: each label of the host, each part of the path, and each name and name=value of the query; numbers are one token."""
    plain = lambda x: F.when(x.rlike(r"^[0-9]+$"), F.lit("#")).otherwise(x)
    split = lambda text, marks: F.filter(F.split(text, marks), lambda x: x != "")
    labels = F.transform(split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("p:"), plain(x)))
    query = split(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"(?s)^[^#]*?://[^?#]*\?([^#]*)", 1), "&")
    names = F.transform(query, lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    pairs = F.transform(F.filter(query, lambda x: F.contains(x, F.lit("="))), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1), F.lit("="), plain(F.regexp_extract(x, "(?s)=(.*)$", 1))))
    return F.array_sort(F.array_distinct(F.concat(labels, parts, names, pairs)))


def lower_end(hits: Column, of: Column, z: float) -> Column:
    """The lower end of the Wilson interval of a share."""
    p = hits / of
    return (p + z * z / (2 * of) - z * F.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


@dataclass(frozen=True)
class Labelled:
    """Counted tokens of labelled rows: ``tokens`` (row, bad, token) and ``seen`` (token, n, n_bad, and two marks of the rows that have it)."""

    tokens: DataFrame
    seen: DataFrame
    n: int
    bad: int

    @property
    def base(self) -> float:
        return self.bad / self.n if self.n else 0.0

    def need(self, params: MiningParams) -> int:
        """Bad rows that a rule needs."""
        return max(params.min_rows, math.ceil(params.min_support * self.n))


def count_tokens(labelled: DataFrame) -> Labelled:
    """Of rows of (tokens, bad)."""
    rows = materialize(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "bad"), "labelled")
    total = rows.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    tokens = rows.select("row", "bad", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64(*by)).alias(name) for name, by in (("mark", ["row"]), ("mark2", [F.lit(1), "row"]))]
    seen = materialize(tokens.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), *marks), "tokens")
    return Labelled(tokens, seen, total["n"], total["bad"])


def grow_sets(baskets: DataFrame, need: int) -> DataFrame:
    """By FP-growth: ``(antecedent, n_bad, n_rows)`` of all sets of items with ``need`` bad baskets or more. ``baskets``: rows of (items, bad)."""
    baskets = materialize(baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "baskets")
    mined = baskets.count()
    # FP-growth takes a share of the baskets and rounds its count up
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / mined) if mined else 1.0, minConfidence=0.0).fit(baskets)
    found = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    with_bad = found.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("antecedent"), F.col("freq").alias("n_bad"))
    return with_bad.join(found.select(F.col("items").alias("antecedent"), F.col("freq").alias("n_rows")), "antecedent").select("antecedent", "n_bad", "n_rows")


def free_sets(held: DataFrame, need: int, scratch: Scratch) -> DataFrame:
    """Level by level: ``(antecedent, n_bad, n_rows)`` of the sets of tokens with ``need`` bad rows or more that can be rules of their own. ``held``: row, bad, token.

    A set that leaves as many rows as one of its parts says the same as that part, and a set of bad rows alone can't be bettered: neither they
    nor sets that hold them are followed, as every rule on them is implied by a shorter one. All else is, so that no rule is lost; where
    rows share many tokens but few rows, as repeating paths do, these are far fewer sets than FP-growth has.
    """
    spark = held.sparkSession
    counted = lambda rows, *by: rows.groupBy(*by).agg(F.count_if("bad").alias("n_bad"), F.count("*").alias("n_rows")).where(F.col("n_bad") >= need)
    found = scratch.write(counted(held, "token").select(F.array("token").alias("antecedent"), "n_bad", "n_rows"), "sets")
    levels, rounds = [found], Rounds(spark)
    sets = held.select("row", "bad", F.array().cast("array<string>").alias("head"), F.col("token").alias("last"))
    while True:
        alive = found.where("n_bad < n_rows")
        at = F.concat("head", F.array("last"))
        sets = rounds.write(sets.withColumn("antecedent", at).join(alive.select("antecedent"), "antecedent", "left_semi").drop("antecedent"))
        left, right = sets.select("row", "bad", "head", F.col("last").alias("middle")), sets.select("row", "head", "last")
        sets = left.join(right, ["row", "head"]).where("middle < last").select("row", "bad", F.concat("head", F.array("middle")).alias("head"), "last")
        wider = counted(sets, "head", "last").select(at.alias("antecedent"), "n_bad", "n_rows")
        parts = wider.withColumn("gone", F.explode("antecedent")).withColumn("part", F.array_remove("antecedent", F.col("gone")))
        said = parts.join(alive.select(F.col("antecedent").alias("part"), F.col("n_rows").alias("part_rows")), "part").where("part_rows > n_rows")
        found = scratch.write(said.groupBy("antecedent", "n_bad", "n_rows").agg(F.count("*").alias("k")).where(F.col("k") == F.size("antecedent")).drop("k"), "sets")
        if found.isEmpty():
            scratch.paths += rounds.paths
            return functools.reduce(DataFrame.unionByName, levels)
        levels.append(found)


def prune_rules(found: DataFrame, known: Labelled, params: MiningParams) -> DataFrame:
    """Rules of (antecedent, n_bad, n_rows) by confidence and implication; columns rule_id, antecedent (its rarest token first), confidence, n_bad, n_rows."""
    rules = found.withColumn("confidence", F.col("n_bad") / F.col("n_rows"))
    rules = rules.where((F.col("n_bad") >= known.need(params)) & (F.col("confidence") >= params.min_confidence) & (lower_end(F.col("n_bad"), F.col("n_rows"), params.interval) > known.base))
    rules = materialize(rules.withColumn("rule_id", F.xxhash64("antecedent")), "rules")
    # a rule whose antecedent holds a shorter rule of no less confidence adds nothing: look the shorter ones up by their smallest token
    short = rules.select(F.col("antecedent").alias("s"), F.col("confidence").alias("c"), F.col("antecedent")[0].alias("token"))
    longer = rules.select("*", F.explode("antecedent").alias("token")).join(short, "token")
    implied = longer.where((F.size("s") < F.size("antecedent")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("s", "antecedent")) == 0))
    kept = rules.join(implied.select("rule_id").distinct(), "rule_id", "left_anti")
    rarest = kept.select("rule_id", F.explode("antecedent").alias("token")).join(known.seen.select("token", "n"), "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return kept.join(rarest, "rule_id").select("rule_id", F.concat(F.array("token"), F.array_remove("antecedent", F.col("token"))).alias("antecedent"), "confidence", "n_bad", "n_rows")


def mine_all_rules(labelled: DataFrame, params: MiningParams = MiningParams()) -> tuple[DataFrame, DataFrame]:
    """All rules ``antecedent -> bad`` from rows of (tokens, bad), pruned as by ``prune_rules``, and ``same`` (token, name).

    Tokens of the very same rows (told by their number and a 128-bit mark) stand in rules by one name, for which each of them may be put. Rows bring all their names:
    FP-growth mines them where none has more than ``mined_tokens``, else they are mined by ``free_sets``. Both leave the same rules.
    """
    known, by = count_tokens(labelled), ["n", "mark", "mark2"]
    need = known.need(params)
    # a token of all rows says nothing, and what it is joined with says the same alone
    telling = known.seen.where((F.col("n_bad") >= need) & (F.col("n") < known.n))
    same = materialize(telling.join(telling.groupBy(*by).agg(F.min("token").alias("name")), by).select("token", "name"), "names")
    scratch = Scratch(labelled.sparkSession)
    held = scratch.write(known.tokens.join(same.where("token = name").select("token"), "token"), "held")
    widest = held.groupBy("row").count().agg(F.max("count")).first()[0] or 0
    if widest <= params.mined_tokens:
        found = grow_sets(held.groupBy("row").agg(F.collect_list("token").alias("items"), F.first("bad").alias("bad")), need)
    else:
        found = free_sets(held, need, scratch)
    rules = materialize(prune_rules(found, known, params), "kept")
    scratch.clear()
    return rules, same


def mine_rules(labelled: DataFrame, params: MiningParams = MiningParams()) -> DataFrame:
    """Rules as by ``mine_all_rules``, but of the ``mined_tokens`` most telling tokens of each row alone, each under its own name: a bounded first look, which ``filter_urls`` doesn't use."""
    known = count_tokens(labelled)
    # a rule's tokens all have min_rows bad rows themselves; of each URL's the most telling ones are mined
    telling = known.seen.where(F.col("n_bad") >= params.min_rows).select("token", lower_end(F.col("n_bad"), F.col("n"), params.interval).alias("sure"))
    best = known.tokens.join(telling, "token").groupBy("row", "bad").agg(F.array_sort(F.collect_list(F.struct((-F.col("sure")).alias("less"), "token"))).alias("found"))
    items = F.transform(F.slice("found", 1, params.mined_tokens), lambda x: x["token"])
    return prune_rules(grow_sets(best.select(items.alias("items"), "bad"), known.need(params)), known, params)


def match_rules(urls: DataFrame, rules: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """``(key, confidence)`` of the ``urls`` (key, tokens) that some rule matches, through the inverted index by the rules' rarest tokens.

    Rules found so are checked by counting which of their tokens the URL has. No row carries a URL's whole list, so a list's length matters once.
    ``same``: names of the tokens (token, name), if rules stand for all tokens of a name.
    """
    index = rules.select(F.col("antecedent")[0].alias("token"), "rule_id", "antecedent", "confidence")
    tokens = urls.select("key", F.explode(F.array_distinct("tokens")).alias("token"))
    if same is not None:
        used = same.join(rules.select(F.explode("antecedent").alias("name")).distinct(), "name", "left_semi")
        tokens = tokens.join(used, "token").select("key", F.col("name").alias("token")).distinct()
    found = tokens.join(index, "token").select("key", "rule_id", "confidence", F.size("antecedent").alias("needs"), F.explode("antecedent").alias("token"))
    hits = found.join(tokens, ["key", "token"]).groupBy("key", "rule_id", "confidence", "needs").agg(F.count("*").alias("n")).where("n = needs")
    return hits.groupBy("key").agg(F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None, params: MiningParams = MiningParams(), url: str = "url") -> DataFrame:
    """Judge each page: adds host, path, rule, mined_confidence and verdict. ``labels``: url key rows of (url, bad boolean)."""
    rules = RULES if rules is None else rules
    names = [c for c in pages.columns if c not in {"host", "path", "rule", "verdict", "mined_confidence"}]
    parsed = split_url(pages.select(*names), url)
    known = split_url(labels.select("url", "bad").where(F.col("url").isNotNull() & F.col("bad").isNotNull())).select(url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "bad")
    tokens = url_tokens(F.col(url), F.col("host"), F.col("path"))
    mined, same = mine_all_rules(known, params)
    # each distinct set of tokens is matched once, however many pages have it
    sets = parsed.select(tokens.alias("tokens")).distinct().select(F.sha2(F.to_json("tokens"), 256).alias("key"), "tokens")
    matched = match_rules(sets, mined, same).select(F.col("key").alias("__key"), F.col("confidence").alias("mined_confidence"))
    # very many pages may have one set: they are dealt by their own hash to parts, and each matched set goes to all of them
    parts = F.sequence(F.lit(0).cast("bigint"), F.lit(params.salts - 1).cast("bigint"))
    matched = matched.withColumn("__part", F.explode(parts))
    name, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    dealt = parsed.withColumns({"__set": F.sha2(F.to_json(tokens), 256), "__salt": F.pmod(F.xxhash64(*names), F.lit(params.salts).cast("bigint"))})
    judged = dealt.join(matched, (F.col("__set") == F.col("__key")) & (F.col("__salt") == F.col("__part")), "left")
    return judged.select(
        *names, "host", "path", name.alias("rule"), "mined_confidence", F.coalesce(verdict, F.when(F.col("mined_confidence").isNotNull() & (F.col("host") != ""), F.lit("block")).otherwise("allow")).alias("verdict")
    )
