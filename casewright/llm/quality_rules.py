"""Host-level quality rules, with DataFrame functions alone.

Each document is measured by rules of its own text. The failures are summed by host, each host's failure rate
is shrunk towards the corpus with a beta prior fitted to the hosts themselves (method of moments), and the
hosts' verdicts are joined back to the documents: a host goes as a whole if the odds of its shrunken rate are more than
``max_host_odds`` times those of the whole table. Where hosts differ no more than chance has it, the prior is strong and none goes.

Defined results: a null text has no words and fails the base rules; documents with a null host form a host of
their own, which is never rejected as a whole; repeated rows count as often as they occur; an empty table gives an
empty table. Columns of the input that are named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize, words

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class HostRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 50  # symbols for each 100 words, counted as a failure of the host only
    max_host_odds: float = 3.0  # of the shrunken failure rate, as a multiple of the whole table's odds of failing
    least_strength: float = 2.0  # of the prior, in documents
    most_strength: float = 1000.0


def _repeated_words(w: Column, marks: Column) -> Column:
    """Words covered by 3-word windows whose start is in the ascending array ``marks``."""
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("total"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total"))
    return F.aggregate(marks, zero, step, lambda acc: acc["total"])


def measure(docs: DataFrame, text: str = "text", rules: HostRules = HostRules()) -> DataFrame:
    """Add the measures, ``base_failed`` and ``rule_failed`` to each document. No shuffle.

    Windows are compared by their 64-bit hash within one text only. Sorting (hash, position) pairs finds the
    repeated ones in n log n steps, so long texts cost no more for each word than short ones.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    plain = docs.withColumn("__words", words(F.col(text)))
    n = F.size("__words")
    windows = F.arrays_zip(*[F.slice("__words", k, F.greatest(n - 2, F.lit(0))).alias(f"w{k}") for k in (1, 2, 3)])
    plain = plain.withColumn("__grams", F.array_sort(F.transform(windows, lambda x, i: F.struct(F.xxhash64(x["w1"], x["w2"], x["w3"]).alias("h"), i.alias("p")))))
    same = lambda x, i, d: F.coalesce(F.get("__grams", i + d)["h"] == x["h"], F.lit(False))
    marked = F.filter(F.transform("__grams", lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["p"])), lambda p: p.isNotNull())
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    plain = plain.withColumn("__marks", F.sort_array(marked)).withColumn("__lines", lines)
    measured = plain.withColumns(
        {
            "n_words": n.cast("bigint"),
            "word_chars": F.length(F.translate(t, BLANKS, "")).cast("bigint"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_repeat_words": _repeated_words(F.col("__words"), F.col("__marks")),
        }
    ).drop("__words", "__grams", "__marks", "__lines")
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("rule_failed", base | (100 * F.col("n_symbols") > rules.max_symbol_percent * F.col("n_words")))


def host_verdicts(measured: DataFrame, host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """One row for each host: documents, failures, shrunken rate and whether the whole host is rejected.

    Counts combine before the shuffle, so a host with a third of all rows sends one row from each task. Only the two
    numbers of the prior come to the driver.
    """
    hosts = materialize(measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.count_if("rule_failed").alias("n_failed")), "hosts")
    moments = hosts.agg(
        F.sum("n_docs").alias("docs"),
        F.sum("n_failed").alias("failed"),
        F.count("*").alias("hosts"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("square"),
    ).first()
    total, failed, k = moments["docs"] or 0, moments["failed"] or 0, moments["hosts"]
    rate = failed / total if total else 0.0
    # variance of the hosts' rates, weighted by documents, less what sampling alone would give
    spread = max(0.0, (moments["square"] or 0.0) / total - rate * rate - rate * (1 - rate) * k / total) if total else 0.0
    strength = rules.most_strength if spread == 0 else rate * (1 - rate) / spread - 1
    strength = min(rules.most_strength, max(rules.least_strength, strength))
    shrunk = (F.col("n_failed") + rate * strength) / (F.col("n_docs") + strength)
    worse = F.col("host_rate") * (1 - rate) > rules.max_host_odds * rate * (1 - F.col("host_rate"))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host").isNotNull() & worse)


def judge(measured: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Join the verdicts back. ``measured`` should be written already; hosts below the session's broadcast threshold are
    broadcast by Spark, more are joined by a sort-merge join whose hot hosts adaptive execution splits."""
    v = hosts.select(F.col("host").alias("__host"), "host_rate", "host_rejected")
    joined = measured.join(v, F.col(host) == F.col("__host"), "left").drop("__host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, rules: HostRules = HostRules()) -> DataFrame:
    """Measure, aggregate by host, and judge each document. ``keep``: columns of ``docs`` to carry (all, if None)."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in {*MEASURES, "base_failed", "rule_failed", "host_rate", "host_rejected", "kept"}]
    carried = list(dict.fromkeys([*names, host]))
    measured = materialize(measure(docs, text, rules).select(*carried, *MEASURES, "base_failed", "rule_failed"), "measured")
    out = judge(measured, host_verdicts(measured, host, rules), host)
    return out.select(*names, *MEASURES, "base_failed", "rule_failed", "host_rate", "kept")
