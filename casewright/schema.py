"""The event model, its enumerations and the configuration of the rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.fields import IDENTITY, Identity

OPTIONAL = ["user", "source_host", "destination_host", "source_ip", "destination_ip", "process", "file", "severity"]
MODEL = ["event_id", "timestamp", "event_type", "action", *OPTIONAL]
SOURCE_TYPES = ["SIEM", "EDR", "Sysmon", "authentication", "network", "host", "dataset", "simulation"]
STATUSES = ["OPEN", "UNDER_REVIEW", "CLOSED"]
OUTCOMES = ["CONTINUE_INVESTIGATION", "ESCALATE", "CLOSE_AS_INVESTIGATED"]
ENTITY_TYPES = ["User", "Host", "Server", "IP", "Process", "File"]
RELATIONSHIP_TYPES = ["LOGGED_INTO", "AUTHENTICATED_TO", "EXECUTED", "CONNECTED_TO", "ACCESSED"]

#: Internal field to the source names that mean it, the first one present counts.
FIELD_MAP = {
    "event_id": ["event_id", "EventID"],
    "timestamp": ["timestamp", "UtcTime", "event_time"],
    "event_type": ["event_type", "EventType"],
    "action": ["action", "Action"],
    "user": ["user", "AccountName", "UserName", "username"],
    "source_host": ["source_host", "ComputerName", "hostname"],
    "destination_host": ["destination_host", "DestinationHostname"],
    "source_ip": ["source_ip", "SourceIp"],
    "destination_ip": ["destination_ip", "DestinationIp"],
    "process": ["process", "Image", "process_name"],
    "file": ["file", "TargetFilename"],
    "severity": ["severity", "Severity"],
}


@dataclass(frozen=True)
class Rules:
    """What correlation and extraction may be tuned by, without touching the graph. ``identity`` says what makes two names one entity."""

    window_seconds: int = 600
    derive_process_edges: bool = True
    server_pattern: str = "-SRV-"
    compatible: list[tuple[str, str]] = field(default_factory=lambda: [("login", "execute"), ("authenticate", "execute"), ("execute", "connect"), ("connect", "access")])
    weights: dict[str, float] = field(default_factory=dict)  # evidence support for each signal; empty: no strength
    identity: Identity = IDENTITY


RULES = Rules()
