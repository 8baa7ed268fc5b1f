"""Security-incident reconstruction on Spark: events in, evidence-backed entities, relationships, correlations and timelines out."""
