"""Literal events of the worked scenarios, and the edges they are expected to give."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import INGESTED

DAY = "2026-09-18T"


def event(event_id: str, time: str, event_type: str, action: str, source: str = "Sysmon", **fields: str) -> dict:
    return {"event_id": event_id, "timestamp": f"{DAY}{time}Z", "event_type": event_type, "action": action, "source": source, **fields}


A = [
    event("evt-1000", "10:00:00", "authentication", "login", "auth", user="Rahul", source_host="ENG-PC-27"),
    event("evt-1002", "10:02:00", "process", "execute", source_host="ENG-PC-27", process="powershell.exe"),
    event("evt-1004", "10:04:00", "network", "connect", source_host="ENG-PC-27", destination_host="FIN-SRV-02"),
    event("evt-1006", "10:06:00", "file", "access", "file", source_host="FIN-SRV-02", file="FinancialReport.xlsx"),
]
B = [
    event("evt-2000", "10:03:00", "authentication", "login", "auth", user="Asha", source_host="HR-PC-03"),
    event("evt-2001", "18:00:00", "process", "execute", user="Omar", source_host="OPS-PC-11", process="cmd.exe"),
]
C = [e | {"event_id": e["event_id"].replace("evt-1", "evt-3")} | ({"user": "backup_svc"} if "user" in e else {}) | {"change_ticket": "CHG-1"} for e in A]
D = A + [
    event("evt-4000", "10:05:00", "authentication", "login", "auth", user="Mina", source_host="HR-PC-09"),
    event("evt-4001", "13:05:00", "network", "connect", user="Jon", source_host="OPS-PC-12", destination_host="FIN-SRV-02"),
]
SCENARIOS = {"A": A, "B": B, "C": C, "D": D}

#: (relationship, source, destination)
CHAIN = [("EXECUTED", "ENG-PC-27", "ENG-PC-27|powershell.exe"), ("CONNECTED_TO", "ENG-PC-27", "FIN-SRV-02"), ("CONNECTED_TO", "ENG-PC-27|powershell.exe", "FIN-SRV-02"), ("ACCESSED", "FIN-SRV-02", "FinancialReport.xlsx")]
EXPECTED = {
    "A": [("LOGGED_INTO", "rahul", "ENG-PC-27"), *CHAIN],
    "B": [("LOGGED_INTO", "asha", "HR-PC-03"), ("EXECUTED", "OPS-PC-11", "OPS-PC-11|cmd.exe")],
    "C": [("LOGGED_INTO", "backup_svc", "ENG-PC-27"), *CHAIN],
    "D": [("LOGGED_INTO", "rahul", "ENG-PC-27"), *CHAIN, ("LOGGED_INTO", "mina", "HR-PC-09"), ("CONNECTED_TO", "OPS-PC-12", "FIN-SRV-02")],
}

#: Raw texts of the parser and validation cases.
CASES = [
    '{"EventID":"p-1","EventType":"process","Action":"execute","AccountName":"Rahul","ComputerName":"ENG-PC-27","UtcTime":"2026-09-18T10:02:00Z","Image":"C:\\\\Windows\\\\powershell.exe"}',
    '{"event_id":"p-2","event_type":"process","action":"execute","username":"Rahul","hostname":"ENG-PC-27","event_time":"2026-09-18T15:32:00+05:30","process_name":"powershell.exe"}',
    '{"event_id":"p-3","event_type":"authentication","action":"login","timestamp":"nope","user":"a"}',
    '{"event_id":"p-4","event_type":"authentication","action":"login","timestamp":"2026-09-18T10:00:00Z","Foo":1}',
    '{"event_id":"evt-1003","event_type":"authentication","action":"login","user":null}',
    "{bad",
    '{"event_id":"p-5","event_type":"authentication","action":"login","timestamp":"2026-09-18T10:00:00Z","user":""}',
    '{"event_id":"p-1","event_type":"file","action":"access","timestamp":"2026-09-18T11:00:00Z"}',
    '{"event_id":"p-6","event_type":"authentication","action":"login","timestamp":"2026-09-18T10:00:00Z","user":{"a":1}}',
]


def raw_cases(spark: SparkSession) -> DataFrame:
    rows = [("fix", c, "dataset", "cases", str(k)) for k, c in enumerate(CASES)]
    return _raw(spark, rows)


def raw_scenarios(spark: SparkSession, names: str = "ABCD") -> DataFrame:
    """Each scenario is an investigation of its own."""
    rows = [(n, json.dumps({k: v for k, v in e.items() if k != "source"}), "dataset", e["source"], e["event_id"]) for n in names for e in SCENARIOS[n]]
    return _raw(spark, rows)


def _raw(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    schema = "investigation_id string, raw string, source_type string, source_name string, source_record_id string"
    return spark.createDataFrame(rows, schema).withColumn("ingested_at", F.lit(INGESTED).cast("timestamp"))


def expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, *e) for s, edges in EXPECTED.items() for e in edges], "scenario string, relationship_type string, src_key string, dst_key string")
