"""Parse, normalize and validate: ``raw_events`` to ``security_events`` and ``rejected_events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as f
from ..schema import FIELD_MAP, MODEL, OPTIONAL

#: Side columns of the model: the parts of a user's name, and the severity where it is a number.
ACCOUNT = ["user_account", "user_domain", "severity_level"]
ERROR = "struct<status:int,error:string,message:string>"


def parse(raw: DataFrame) -> DataFrame:
    """Add ``fields`` (a map of the JSON object's members as text, null if malformed), ``format`` and ``parse_error``."""
    fields = F.from_json("raw", "map<string,string>", {"mode": "PERMISSIVE"})
    # explode of one element: the optimizer would else repeat the parsing for every field that is taken from the map
    parsed = raw.select("*", F.explode(F.array(F.when(F.ltrim("raw").startswith("{"), fields))).alias("fields"))
    kind = F.when(F.map_contains_key("fields", "AccountName") | F.map_contains_key("fields", "UtcTime"), "A").when(F.map_contains_key("fields", "username") | F.map_contains_key("fields", "event_time"), "B")
    bad = F.struct(F.lit(400).alias("status"), F.lit("PARSE_ERROR").alias("error"), F.lit("event is not a JSON object").alias("message"))
    return parsed.withColumn("format", F.when(F.col("fields").isNotNull(), F.coalesce(kind, F.lit("internal")))).withColumn("parse_error", F.when(F.col("fields").isNull(), bad))


def state(name: str, fields: str = "fields") -> Column:
    """MISSING, NULL, EMPTY or VALUE."""
    value = F.col(fields)[name]
    return F.when(~F.map_contains_key(fields, name), "MISSING").when(value.isNull(), "NULL").when(value == "", "EMPTY").otherwise("VALUE")


def primitives(raw: DataFrame, field_map: dict[str, list[str]] = FIELD_MAP) -> DataFrame:
    """The members of raw events that the model doesn't know, each as what it is: ``name``, ``kind`` and one of ``whole``, ``number``, ``flag``, ``moment`` and ``text``.

    The raw text is parsed once as a VARIANT, whose own types tell 5 from "5". Texts that are timestamps are moments; decimals and exponents are numbers. Objects
    and arrays keep their JSON as text; null members have a kind alone; raw text that is no JSON object has no members.
    """
    known = [n for names in field_map.values() for n in names]
    parsed = raw.select("investigation_id", "source_record_id", F.try_parse_json("raw").alias("__v")).where(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")))
    each = parsed.lateralJoin(raw.sparkSession.tvf.variant_explode(F.col("__v").outer())).where(~F.col("key").isin(known))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    as_ = lambda t: F.try_variant_get("value", "$", t)
    text = F.when(kind == "STRING", as_("string"))
    moment = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), f.utc_timestamp(text))
    kind = F.when(moment.isNotNull(), "TIMESTAMP").when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"), "NUMBER").otherwise(kind)
    return each.select(
        "investigation_id",
        "source_record_id",
        F.col("key").alias("name"),
        kind.alias("kind"),
        F.when(kind == "BIGINT", as_("bigint")).alias("whole"),
        F.when(kind == "NUMBER", as_("double")).alias("number"),
        F.when(kind == "BOOLEAN", as_("boolean")).alias("flag"),
        moment.alias("moment"),
        F.when(kind == "STRING", text).when(kind.isin("OBJECT", "ARRAY"), F.to_json("value")).alias("text"),
    )


def _values(field_map: dict[str, list[str]]) -> Column:
    """Of each internal field the first source name with a value, and that value; nulls where there is none.

    The names are data of one lambda, not an expression each: code for so many lookups in one method is more than the JVM compiles (8000 bytes), and ran ten times slower.
    """
    names = F.array(*[F.array(*[F.lit(n) for n in ns]) for ns in field_map.values()])
    present = lambda n: f.blank_to_null(F.col("fields")[n]).isNotNull()
    return F.transform(F.transform(names, lambda ns: F.get(F.filter(ns, present), F.lit(0))), lambda n: F.struct(n.alias("name"), f.blank_to_null(F.col("fields")[n]).alias("value")))


def normalize(parsed: DataFrame, field_map: dict[str, list[str]] = FIELD_MAP, zone: str = "UTC", ipv6: bool = False) -> DataFrame:
    """Vendor fields to the model; the names that were used, unknown fields, the raw text and the timestamp's text are kept."""
    known = F.array(*[F.lit(n) for names in field_map.values() for n in names])
    out = parsed.select("*", F.explode(F.array(_values(field_map))).alias("__values"))  # evaluated once, as in parse
    out = out.withColumns({k: F.get("__values", F.lit(i))["value"] for i, k in enumerate(field_map)})
    used = F.arrays_zip(F.array(*[F.lit(k) for k in field_map]).alias("key"), F.col("__values.name").alias("value"))
    out = out.withColumns(
        {
            "timestamp_raw": F.col("timestamp"),
            "user_account": f.account_name(F.col("user")),
            "user_domain": f.account_domain(F.col("user")),
            "severity_level": F.col("severity").try_cast("int"),
            "timestamp": f.utc_timestamp(F.col("timestamp"), zone),
            "source_ip": f.ip_address(F.col("source_ip"), ipv6),
            "destination_ip": f.ip_address(F.col("destination_ip"), ipv6),
            "field_mapping": F.map_from_entries(F.filter(used, lambda x: x["value"].isNotNull())),
            "raw_data": F.col("raw"),
            "unknown_fields": F.map_filter("fields", lambda k, v: ~F.array_contains(known, k)),
        }
    )
    fresh = [c for c in out.columns if c not in parsed.columns and c != "__values"]
    return out.select(*parsed.columns, F.inline(F.array(F.struct(*fresh))))  # evaluated once, too


def _error(message: str) -> Column:
    return F.struct(F.lit(400).alias("status"), F.lit("VALIDATION_ERROR").alias("error"), F.lit(message).alias("message"))


def validate(normalized: DataFrame, field_map: dict[str, list[str]] = FIELD_MAP) -> DataFrame:
    """Add ``errors``: the parse error, or what is wrong with the model's fields. Optional fields may be absent, but must be scalars."""
    def nested(k: str) -> Column:
        """Whether a name of the field has an object or array; texts that merely look like one are told from these by the JSON value's type."""
        found = F.lit(False)
        for n in field_map[k]:
            kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("raw"), f"$.{n}", "variant"))
            looks = F.coalesce(F.col("fields")[n].rlike(r"^\s*[\[{]"), F.lit(False))
            found = found | F.when(looks, F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(True))).otherwise(False)
        return found

    checks = [F.when(F.col(k).isNull() & F.col("parse_error").isNull(), _error(f"{k} is required")) for k in ("event_id", "event_type", "action")]
    checks.append(F.when(F.col("timestamp_raw").isNull() & F.col("parse_error").isNull(), _error("timestamp is required")))
    checks.append(F.when(F.col("timestamp_raw").isNotNull() & F.col("timestamp").isNull(), _error("timestamp is malformed")))
    checks += [F.when(nested(k), _error(f"{k} must be a scalar")) for k in OPTIONAL]
    return normalized.withColumn("errors", F.array_compact(F.array(F.col("parse_error").cast(ERROR), *[c.cast(ERROR) for c in checks])))


def mark_duplicates(validated: DataFrame) -> DataFrame:
    """The earliest ingested valid row of an event id stays, later valid ones get an error. A row that has an error already takes no id.

    Rows without an id and rows with errors are spread over the tasks.
    """
    valid = (F.size("errors") == 0) & F.col("event_id").isNotNull()
    spread = F.when(~valid, F.xxhash64("raw", "source_record_id") % 4096)
    order = Window.partitionBy("investigation_id", "event_id", spread).orderBy("ingested_at", "source_record_id", "raw")
    again = valid & (F.row_number().over(order) > 1)
    return validated.withColumn("errors", F.when(again, F.array_append("errors", _error("event_id occurs already").cast(ERROR))).otherwise(F.col("errors")))


def security_events(validated: DataFrame) -> DataFrame:
    """Valid events alone; all later steps read these."""
    envelope = ["investigation_id", "source_type", "source_name", "source_record_id", "ingested_at", "timestamp_raw", "field_mapping", "unknown_fields", "raw_data"]
    return validated.where(F.size("errors") == 0).select(*MODEL, *ACCOUNT, *envelope)


def rejected_events(validated: DataFrame) -> DataFrame:
    """One structured error for each invalid row, its first."""
    e = F.col("errors")[0]
    return validated.where(F.size("errors") > 0).select("investigation_id", e["status"].alias("status"), e["error"].alias("error"), e["message"].alias("message"), "event_id", "raw", "source_type", "source_name", "ingested_at")


def error_envelope(rejected: DataFrame) -> DataFrame:
    return rejected.withColumn("body", F.to_json(F.struct("status", "error", "message", "event_id")))


def ingest(raw: DataFrame, dedupe: bool = True, **options: object) -> DataFrame:
    """All steps; ``dedupe`` needs a shuffle by event id and can be left out for sources that are known to have unique ids."""
    out = validate(normalize(parse(raw), **options))
    return mark_duplicates(out) if dedupe else out
