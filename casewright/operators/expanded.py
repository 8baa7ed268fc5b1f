"""Entity types and relationships that are declared in tables, so that new ones need no code.

``ENTITIES``: type, JSON path in the raw event, role (a name for the place), and how its key is made: ``plain``, ``lower``, ``upper``, or with ``@role`` after it,
scoped to another entity's key of the same event (``lower@source_host``: a session of that host). ``EDGES``: relationship, from role and to role,
and, where given, the only action that makes it. Roles of the event model (``user``, ``source_host``, ...) can be ends of edges and scopes too.

The raw event is parsed once as a VARIANT; a path that isn't there, or holds an object or array, gives nothing. The tables are configuration
(at most ``MOST`` rows each, checked) and become columns of one pass over the events.

Defined results: blank values and scopes without a key make no entity; unknown roles, rules and repeated roles are an error; raw text that is no JSON
has none of these entities; an empty declaration gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as f
from ..schema import RULES, Rules
from .cases import EngineError
from .extract import with_roles

ENTITIES = "entity_type string, path string, role string, rule string"
EDGES = "relationship_type string, from_role string, to_role string, action string"
MOST = 500
RULE_NAMES = {"plain": lambda c: c, "lower": F.lower, "upper": F.upper}


def _rows(table: DataFrame, what: str) -> list:
    rows = table.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise EngineError(400, f"more than {MOST} declared {what}")
    return rows


def _known(rules: Rules) -> dict[str, tuple[Column, Column]]:
    """Type and key of the event model's roles."""
    c, i = F.col, rules.identity
    return {
        "user": (F.lit("User"), i.user(c("user"))),
        "source_host": (c("source_type_of"), i.host(c("source_host"))),
        "destination_host": (c("destination_type_of"), i.host(c("destination_host"))),
        "source_ip": (F.lit("IP"), c("source_ip")),
        "destination_ip": (F.lit("IP"), c("destination_ip")),
        "process": (F.lit("Process"), i.process(c("source_host"), c("process"))),
        "file": (F.lit("File"), i.file(c("file"))),
    }


def _declared(events: DataFrame, entities: DataFrame, rules: Rules) -> tuple[DataFrame, dict[str, str], dict[str, tuple[Column, Column]]]:
    """Events with a column for each declared role (key, name), the roles' types, and the model's roles."""
    declared = sorted(_rows(entities, "entity types"), key=lambda r: r.role)
    known = _known(rules)
    roles = {r.role: r.entity_type for r in declared}
    if len(roles) < len(declared) or set(roles) & set(known):
        raise EngineError(400, "a role is declared twice")
    # one value, parsed once for all paths
    out = with_roles(events, rules=rules).select("*", F.explode(F.array(F.try_parse_json("raw_data"))).alias("__v"))
    names = {r.role: f.blank_to_null(F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get("__v", r.path, "variant")).rlike("^(OBJECT|ARRAY)"), F.lit(False)), F.try_variant_get("__v", r.path, "string"))) for r in declared}
    out = out.withColumns({f"__name_{role}": name for role, name in names.items()})
    for r in declared:
        rule, _, scope = r.rule.partition("@")
        if rule not in RULE_NAMES or scope and scope not in known:
            raise EngineError(400, f"unknown rule {r.rule}")
        key = RULE_NAMES[rule](F.col(f"__name_{r.role}"))
        out = out.withColumn(f"__key_{r.role}", F.concat(known[scope][1], F.lit("|"), key) if scope else key)
    return out, roles, known


def occurrences(events: DataFrame, entities: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Rows as of ``extract.occurrences`` for the declared types; both can be put together for entities."""
    out, roles, _ = _declared(events, entities, rules)
    if not roles:
        return out.where("false").select("investigation_id", "event_id", "timestamp", *[F.lit("").alias(c) for c in ("entity_type", "entity_key", "name", "role")])
    found = F.array(*[F.struct(F.lit(kind).alias("entity_type"), F.col(f"__key_{role}").alias("entity_key"), F.col(f"__name_{role}").alias("name"), F.lit(role).alias("role")) for role, kind in roles.items()])
    return out.select("investigation_id", "event_id", "timestamp", F.inline(F.filter(found, lambda x: x["entity_key"].isNotNull())))


def observations(events: DataFrame, entities: DataFrame, edges: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Rows as of ``extract.observations`` for the declared relationships: an edge where an event has both ends (and the action, if one is declared)."""
    out, roles, known = _declared(events, entities, rules)
    ends = known | {role: (F.lit(kind), F.col(f"__key_{role}")) for role, kind in roles.items()}
    made = []
    for e in _rows(edges, "relationships"):
        if e.from_role not in ends or e.to_role not in ends:
            raise EngineError(400, f"unknown role in {e.relationship_type}")
        (src_type, src), (dst_type, dst) = ends[e.from_role], ends[e.to_role]
        fits = src.isNotNull() & dst.isNotNull() & (F.lower("action") == e.action.lower() if e.action else F.lit(True))
        made.append(F.when(fits, F.struct(F.lit(e.relationship_type).alias("relationship_type"), src_type.alias("src_type"), src.alias("src_key"), dst_type.alias("dst_type"), dst.alias("dst_key"))))
    kinds = "array<struct<relationship_type:string,src_type:string,src_key:string,dst_type:string,dst_key:string>>"
    rows = out.select("investigation_id", "event_id", "timestamp", F.col("source_name").alias("source"), F.inline(F.array_compact(F.array(*made)).cast(kinds)))
    return rows.withColumns({"event_ids": F.array("event_id"), "derived": F.lit(False), "correlation_signals": F.array().cast("array<string>")})
