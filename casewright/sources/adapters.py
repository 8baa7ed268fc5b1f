"""Sources: anything becomes ``raw_events`` (investigation_id, raw JSON text, source columns), untouched and one row an event.

An adapter is a function from a DataFrame to ``raw_events`` and knows nothing of parsing or correlation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SOURCE_TYPES


def stamp(df: DataFrame, investigation_id: str, source_type: str, source_name: str, record_id: Column | None = None, ingested_at: Column | None = None) -> DataFrame:
    """Add source metadata to rows of ``raw``."""
    if source_type not in SOURCE_TYPES:
        raise ValueError(f"unknown source type {source_type}")
    return df.select(
        F.lit(investigation_id).alias("investigation_id"),
        "raw",
        F.lit(source_type).alias("source_type"),
        F.lit(source_name).alias("source_name"),
        (F.lit(None) if record_id is None else record_id).cast("string").alias("source_record_id"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"),
    )


def json_event(spark: SparkSession, text: str) -> DataFrame:
    """A single event."""
    return spark.createDataFrame([(text,)], "raw string")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; the line is kept as it is, malformed ones too."""
    return spark.read.text(path).select(F.col("value").alias("raw")).where("trim(raw) <> ''")


def json_array(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Events of JSON array bodies; a body that is no array stays a single row, for the parser to reject."""
    events = F.coalesce(F.from_json(column, "array<string>", {"mode": "PERMISSIVE"}), F.array(F.col(column)))
    return bodies.select(F.explode(events).alias("raw"))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; cells that are missing are left out of the JSON.

    A line that doesn't fit the schema (a malformed cell, too many cells) stays as it is, for the parser to reject.
    """
    rows = spark.read.csv(path, header=True, schema=f"{schema}, __line string", mode="PERMISSIVE", columnNameOfCorruptRecord="__line")
    return rows.select(F.coalesce("__line", F.to_json(F.struct(*[c for c in rows.columns if c != "__line"]))).alias("raw"))


def dataset_rows(df: DataFrame) -> DataFrame:
    """Each row of a table as JSON."""
    return df.select(F.to_json(F.struct("*")).alias("raw"))


def mixed(*sources: DataFrame) -> DataFrame:
    """Several sources in one investigation."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines that arrive as files; each trigger takes a bounded batch."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).select(F.col("value").alias("raw"))


#: event_type of the driver's table to (event_type, action).
SIMULATED = {"signup": ("authentication", "authenticate"), "view": ("authentication", "login"), "click": ("process", "execute"), "purchase": ("network", "connect"), "error": ("file", "access")}
PROCESSES = ["powershell.exe", "cmd.exe", "python.exe", "bash"]
INGESTED = "2026-01-01 00:00:00"


def simulation(events: DataFrame, investigation_id: str = "sim") -> DataFrame:
    """The generic ``events`` table as a labelled simulation: deterministic names from its ids and ``props.k``."""
    k = F.get_json_object("props", "$.k").cast("int")
    of = lambda i: F.coalesce(*[F.when(F.col("event_type") == t, v[i]) for t, v in SIMULATED.items()])
    server = F.concat(F.lit("FIN-SRV-0"), (k % 5).cast("string"))
    # some logins go to a server
    far = (F.col("action") == "connect") & (F.col("k") % 4 != 0) | (F.col("action") == "login") & (F.col("k") % 7 == 3)
    workstation = F.concat(F.lit("ENG-PC-"), F.lpad((k % 20).cast("string"), 2, "0"))
    action = F.col("action")
    rows = events.select("event_id", "ts", "user_id", k.alias("k"), of(0).alias("event_type"), of(1).alias("action"), server.alias("server"), workstation.alias("pc"))
    raw = rows.select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "event_type",
        "action",
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"),
        F.when(action == "access", F.col("server")).otherwise(F.col("pc")).alias("source_host"),
        F.when(far, F.col("server")).alias("destination_host"),
        F.when(action.isin("login", "authenticate"), F.concat(F.lit("10.1.0."), (F.col("k") % 20).cast("string"))).alias("source_ip"),
        F.when((action == "connect") & (F.col("k") % 4 == 0), F.concat(F.lit("10.0.0."), (F.col("k") % 5).cast("string"))).alias("destination_ip"),
        F.when(action == "execute", F.coalesce(*[F.when(F.col("k") % 4 == i, p) for i, p in enumerate(PROCESSES)])).alias("process"),
        F.when(action == "access", F.concat(F.lit("file_"), F.col("k").cast("string"), F.lit(".dat"))).alias("file"),
    )
    return stamp(dataset_rows(raw), investigation_id, "simulation", "events", F.get_json_object("raw", "$.event_id"), F.lit(INGESTED).cast("timestamp"))
