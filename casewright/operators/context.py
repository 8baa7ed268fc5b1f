"""The bounded context of a summary, an offline provider, and the check that a summary is grounded."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROMPT = (
    "Use only the supplied evidence. Tell observed facts from inferences. Name the event IDs that support each statement. "
    "Do not invent users, hosts, processes, files or events. Say what remains uncertain."
)
SECTIONS = ["overview", "timeline", "entities", "relationships", "correlations", "uncertainty", "evidence"]
AUDIT = "investigation_id string, provider string, status string, summary string, error string, prompt string, context string"


def context(description: str, timeline: DataFrame, entities: DataFrame, edges: DataFrame, correlations: DataFrame, paths: DataFrame | None = None, limit: int = 50, evidence: int = 20) -> DataFrame:
    """One row with the first rows of each kind under a total order, as JSON, and the prompt that a provider is given with it.

    Each part is cut to ``limit`` rows before it is gathered, and of an edge's or a hop's event ids the first ``evidence`` are shown.
    """
    spark = timeline.sparkSession
    edges = edges.withColumn("event_ids", F.slice("event_ids", 1, evidence))
    if paths is not None:
        paths = paths.withColumn("evidence", F.transform("evidence", lambda e: F.slice(e, 1, evidence)))

    def part(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
        rows = df.select(*columns).orderBy(*order).limit(limit)
        return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("part"))

    parts = {
        "timeline": part(timeline, ["timestamp", "event_id", "action", "user", "source_host"], ["timestamp", "event_id"]),
        "entities": part(entities, ["entity_type", "entity_key", "n_events"], ["entity_type", "entity_key"]),
        "relationships": part(edges, ["relationship_type", "src_key", "dst_key", "event_ids"], ["relationship_type", "src_key", "dst_key"]),
        "correlations": part(correlations.where("related"), ["event_a", "event_b", "signals"], ["event_a", "event_b"]),
    }
    if paths is not None:
        parts["paths"] = part(paths, ["hops", "path", "evidence"], ["hops", "path", "evidence"])
    row = {"description": description, "prompt": PROMPT} | {k: df.first()["part"] for k, df in parts.items()}
    row.setdefault("paths", "[]")
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


class SummaryProvider(ABC):
    @abstractmethod
    def generate_summary(self, context: dict) -> str:
        """A text with the seven sections, from the context's parts and under its ``prompt``."""


class TemplateProvider(SummaryProvider):
    """Works offline; says what the context holds and no more."""

    def generate_summary(self, context: dict) -> str:
        events = json.loads(context["timeline"] or "[]")
        pairs = json.loads(context["correlations"] or "[]")
        body = {
            "overview": f"{context['description']}: {len(events)} events.",
            "timeline": "; ".join(f"{e['timestamp']} {e['action']} ({e['event_id']})" for e in events),
            "entities": ", ".join(f"{e['entity_type']} {e['entity_key']}" for e in json.loads(context["entities"] or "[]")),
            "relationships": "; ".join(f"{r['src_key']} {r['relationship_type']} {r['dst_key']} ({', '.join(r['event_ids'])})" for r in json.loads(context["relationships"] or "[]"))
            + "".join(f"; path {p['path']}" for p in json.loads(context.get("paths") or "[]")),
            "correlations": "; ".join(f"{p['event_a']} and {p['event_b']}: {', '.join(p['signals'])}" for p in pairs),
            "uncertainty": "Related events need not have one cause.",
            "evidence": ", ".join(e["event_id"] for e in events),
        }
        return "\n".join(f"## {s}\n{body[s]}" for s in SECTIONS)


def summarize(row: DataFrame, provider: SummaryProvider) -> dict:
    """The summary with its context; a failing provider leaves ``unavailable``, and everything else as it was."""
    given = row.first().asDict()
    try:
        return {"status": "available", "summary": provider.generate_summary(given), "context": given}
    except Exception as e:
        return {"status": "unavailable", "summary": None, "error": str(e)[:200], "context": given}


def audit(investigation_id: str, done: dict, provider: SummaryProvider, spark: SparkSession, at: Column | None = None) -> DataFrame:
    """The row to append to the ``summaries`` table: the summary or its failure, with the prompt and the context it was made from."""
    given = {k: v for k, v in done["context"].items() if k != "prompt"}
    row = (investigation_id, type(provider).__name__, done["status"], done["summary"], done.get("error"), done["context"].get("prompt"), json.dumps(given, sort_keys=True))
    return spark.createDataFrame([row], AUDIT).withColumn("kind", F.lit("narrative")).withColumn("made_at", F.current_timestamp() if at is None else at)


def statements_of(summaries: DataFrame) -> DataFrame:
    """The statements of summaries: their sections' parts, numbered."""
    lines = F.filter(F.split("summary", r"\n(?:## [a-z]+\n)?|; |^## [a-z]+\n"), lambda x: F.trim(x) != "")
    return summaries.where(F.col("summary").isNotNull()).select("investigation_id", F.posexplode(lines).alias("statement_id", "text"))


#: Marks that are cut off the ends of a word.
MARKS = "()[]{}<>,;:.!?\"'"
MOST_WORDS = 100_000


def words_of(text: Column) -> Column:
    """A text's words in lower case, without marks at their ends."""
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.btrim(w, F.lit(MARKS))), lambda w: w != "")


def mentions(statements: DataFrame, events: DataFrame, entities: DataFrame, vocabulary: DataFrame, most_grams: int = 3) -> DataFrame:
    """What statements (investigation_id, statement_id, text) mention: ``item`` and its ``kind`` (event, entity, unknown), once a statement.

    There is no pattern of what names look like. A dictionary of the investigation's own event ids, names and keys is joined by runs of words: each
    name stands under its first ``most_grams`` words, and a run that begins with these is compared with the whole name. A word that no known
    name covers and that isn't in ``vocabulary`` (rows of word: the ordinary words of narratives) is unknown: an invented name, or one of
    another investigation. Ordinary words that are names of the investigation count as names. The vocabulary is configuration, at most
    ``MOST_WORDS`` rows, checked; it is sent to all tasks, so that ordinary words are dropped before anything is shuffled.
    """
    inv = "investigation_id"
    ordinary = vocabulary.select(F.lower("word").alias("word")).distinct().limit(MOST_WORDS + 1)
    if ordinary.count() > MOST_WORDS:
        raise ValueError(f"a vocabulary of more than {MOST_WORDS} words")
    names = entities.select(inv, F.lit("entity").alias("kind"), F.explode(F.array("name", "entity_key")).alias("item")).unionByName(events.select(inv, F.lit("event").alias("kind"), F.col("event_id").alias("item")))
    names = names.where("item is not null").select(inv, "kind", F.lower("item").alias("item"), words_of(F.col("item")).alias("words")).where(F.size("words") > 0)
    names = names.select(inv, "kind", "item", "words", F.concat_ws(" ", F.slice("words", 1, most_grams)).alias("gram")).distinct()
    said = statements.where(F.col("text").isNotNull()).select(inv, "statement_id", words_of(F.col("text")).alias("text_words"))
    placed = said.select(inv, "statement_id", "text_words", F.posexplode("text_words").alias("at", "word"))
    is_plain = ordinary.select("word", F.lit(True).alias("plain"))
    plain = placed.join(F.broadcast(is_plain), "word", "left").select(inv, "statement_id", "text_words", "at", "word", F.coalesce("plain", F.lit(False)).alias("plain"))
    # ordinary words that are a name by themselves, or begin one, in some investigation are few
    begins = names.select(F.col("words")[0].alias("word")).join(F.broadcast(ordinary), "word", "left_semi").distinct().select("word", F.lit(True).alias("begins"))
    can = plain.join(begins, "word", "left").where(~F.col("plain") | F.col("begins"))
    runs = can.select(inv, "statement_id", "at", "text_words", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(most_grams)), lambda n: F.concat_ws(" ", F.slice("text_words", F.col("at") + 1, n))))).alias("gram"))
    hits = runs.join(names, [inv, "gram"]).where(F.slice("text_words", F.col("at") + 1, F.size("words")) == F.col("words")).select(inv, "statement_id", "at", "kind", "item", F.size("words").alias("n"))
    covered = hits.select(inv, "statement_id", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("at")).distinct()
    unknown = plain.where("not plain").join(covered, [inv, "statement_id", "at"], "left_anti").select(inv, "statement_id", F.lit("unknown").alias("kind"), F.col("word").alias("item"))
    return hits.select(inv, "statement_id", "kind", "item").unionByName(unknown).distinct()


def grounded_statements(statements: DataFrame, found: DataFrame) -> DataFrame:
    """Each statement with what it ``mentions``, counted, and the verdict of ``grounding``."""
    keys = ["investigation_id", "statement_id"]
    counts = found.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("event", "entity", "unknown")])
    out = statements.select(*keys).join(counts, keys, "left").select(*keys, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_event", "n_entity", "n_unknown")])
    return out.withColumn("verdict", F.when(F.col("n_unknown") > 0, "invented").when(F.col("n_event") == 0, "unsupported").otherwise("grounded"))


#: Names that a statement may mention: users, hosts and servers, processes, addresses and files.
ENTITY_PATTERN = r"(?i)\b(user[0-9]+|[A-Z]+-(?:PC|SRV)-[0-9]+|[\w-]+\.(?:exe|dat|xlsx|dll|ps1|sh)|[0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"


def grounding(statements: DataFrame, events: DataFrame, pattern: str = r"(evt-[0-9]+)", entities: DataFrame | None = None, entity_pattern: str = ENTITY_PATTERN) -> DataFrame:
    """Statements (statement_id, text) with the event ids and entities they name, how many of these exist, and a verdict.

    ``grounded``: all that is named exists, an event among it; ``invented``: something named doesn't exist; ``unsupported``: no event is
    named. ``entities``: rows with entity_key and name, to check entities too; names are compared without case.
    """

    def tally(pattern: str, group: int, known: DataFrame, prefix: str) -> DataFrame:
        named = statements.select("statement_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), group), lambda x: F.lower(x)))).alias("item"))
        found = named.join(known.select(F.lower("item").alias("item"), F.lit(1).alias("known")).distinct(), "item", "left")
        return found.groupBy("statement_id").agg(F.count("*").alias(f"{prefix}named"), F.count("known").alias(f"{prefix}known"))

    out = statements.join(tally(pattern, 1, events.select(F.col("event_id").alias("item")), "n_"), "statement_id", "left")
    names = ["n_named", "n_known"]
    if entities is not None:
        known = entities.select(F.explode(F.array("name", "entity_key")).alias("item")).where("item is not null")
        out = out.join(tally(entity_pattern, 1, known, "n_entities_"), "statement_id", "left")
        names += ["n_entities_named", "n_entities_known"]
    out = out.select("statement_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    missing = reduce(lambda a, b: a | b, [F.col(b) < F.col(a) for a, b in zip(names[::2], names[1::2])])
    return out.withColumn("verdict", F.when(missing, "invented").when(F.col("n_named") == 0, "unsupported").otherwise("grounded"))


def grounding_tally(checked: DataFrame, needed: DataFrame | None = None, statements: DataFrame | None = None, pattern: str = r"(evt-[0-9]+)") -> DataFrame:
    """measure, n: supported, unsupported and incorrect statements, and, with the events a summary ``needed``, those that no statement names."""
    kinds = {"supported": "grounded", "unsupported": "unsupported", "incorrect": "invented"}
    counts = checked.agg(*[F.count_if(F.col("verdict") == v).alias(k) for k, v in kinds.items()])
    out = counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in kinds])))
    if needed is None:
        return out
    named = statements.select(F.explode(F.regexp_extract_all("text", F.lit(pattern))).alias("event_id")).distinct()
    missing = needed.select("event_id").distinct().join(named, "event_id", "left_anti").agg(F.count("*").alias("n"))
    return out.unionByName(missing.select(F.lit("missing evidence").alias("measure"), "n"))
