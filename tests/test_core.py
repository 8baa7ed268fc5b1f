"""The engine on the worked scenarios and on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from casewright.functions.fields import Identity, account_key

from casewright.operators import cases, context, correlate, extract, graph, ingest, measure, timeline
from casewright.plans import fixtures, queries
from casewright.tables import Rounds, exists, remove, shared_path, written
from casewright.schema import Rules
from casewright.sources import adapters, sinks
from casewright.streaming import events as streams


@pytest.fixture(scope="module")
def scene(spark):
    events = written(ingest.security_events(ingest.ingest(fixtures.raw_scenarios(spark))), "events")
    edges = written(extract.all_observations(events), "edges")
    related = written(correlate.correlations(correlate.candidates(events), events), "related")
    return {"events": events, "edges": edges, "related": related, "occurrences": extract.occurrences(events)}


def pairs_of(events):
    related = correlate.correlations(correlate.candidates(events), events).where("related")
    return {(r.event_a, r.event_b): set(r.signals) for r in related.collect()}


def make(spark, rows):
    raw = fixtures._raw(spark, [("t", json.dumps(r), "dataset", "test", r["event_id"]) for r in rows])
    return ingest.security_events(ingest.ingest(raw))


def test_parser_and_validation_cases(spark):
    checked = written(ingest.ingest(fixtures.raw_cases(spark)), "checked")
    rejected = {(r.event_id, r.error, r.message) for r in ingest.rejected_events(checked).collect()}
    assert rejected == {
        ("p-3", "VALIDATION_ERROR", "timestamp is malformed"),
        ("evt-1003", "VALIDATION_ERROR", "timestamp is required"),
        (None, "PARSE_ERROR", "event is not a JSON object"),
        ("p-1", "VALIDATION_ERROR", "event_id occurs already"),
        ("p-6", "VALIDATION_ERROR", "user must be a scalar"),
    }
    good = {r.event_id: r for r in ingest.security_events(checked).collect()}
    assert good["p-1"].timestamp == good["p-2"].timestamp and good["p-1"].user == good["p-2"].user == "Rahul"
    assert good["p-5"].user is None and good["p-4"].unknown_fields == {"Foo": "1"}
    assert good["p-1"].field_mapping["user"] == "AccountName"


def test_scenario_a(scene):
    related = {(r.event_a, r.event_b): set(r.signals) for r in scene["related"].where("investigation_id = 'A' and related").collect()}
    assert related == {
        ("evt-1000", "evt-1002"): {"shared_host", "temporal_proximity", "compatible_sequence"},
        ("evt-1000", "evt-1004"): {"shared_host", "temporal_proximity"},
        ("evt-1002", "evt-1004"): {"shared_host", "temporal_proximity", "compatible_sequence"},
        ("evt-1004", "evt-1006"): {"host_continuity", "temporal_proximity", "compatible_sequence"},
    }
    found = graph.paths(scene["edges"], "rahul", end="FinancialReport.xlsx", investigation_id="A").collect()
    assert "rahul > ENG-PC-27 > ENG-PC-27|powershell.exe > FIN-SRV-02 > FinancialReport.xlsx" in {r.path for r in found}
    one = correlate.sequences(scene["related"].where("investigation_id = 'A' and related")).collect()
    assert {r.sequence_id for r in one} == {"evt-1000"} and len(one) == 4


def test_unrelated_events_stay_apart(scene):
    assert scene["related"].where("investigation_id = 'B'").isEmpty()


def test_confusion_is_clean(spark, scene):
    rows = measure.confusion(fixtures.expected(spark), scene["edges"].withColumnRenamed("investigation_id", "scenario")).collect()
    assert all(r.unsupported == r.missed == 0 and r.precision == r.recall == 1 for r in rows) and len(rows) == 4


def test_window_edges_ties_and_nulls(spark):
    e = lambda i, t, **k: {"event_id": i, "timestamp": f"2026-09-18T{t}Z", "event_type": "x", "action": "login", **k}
    got = pairs_of(make(spark, [e("a", "10:00:00", user="u1"), e("b", "10:10:00", user="u1"), e("c", "10:10:00.000001", user="u1")]))
    assert set(got) == {("a", "b"), ("b", "c")}
    assert set(pairs_of(make(spark, [e("a", "10:00:00", user="u"), e("b", "10:00:00", user="u")]))) == {("a", "b")}
    assert pairs_of(make(spark, [e("a", "10:00:00", source_host="H1"), e("b", "10:01:00", source_host="H2")])) == {}
    hosts = [e("a", "10:00:00", source_host="H1", process="p"), e("b", "10:01:00", source_host="H2", process="p")]
    assert pairs_of(make(spark, hosts)) == {}


def test_buckets_equal_plain_join(spark):
    events = written(queries.events(spark, "/root/testdata/sf0.001"), "events")
    keys = correlate.context_keys(events)
    x, y = keys.alias("x"), keys.alias("y")
    plain = x.join(y, (F.col("x.kind") == F.col("y.kind")) & (F.col("x.value") == F.col("y.value")))
    before = F.struct("x.at", "x.event_id") < F.struct("y.at", "y.event_id")
    want = {(r.a, r.b) for r in plain.where(before & (F.col("y.at") - F.col("x.at") <= 600_000_000)).select(F.col("x.event_id").alias("a"), F.col("y.event_id").alias("b")).collect()}
    got = [(r.a, r.b) for r in correlate.candidates(events).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_evidence_and_detail(scene):
    assert timeline.untraceable(scene["edges"], scene["events"]).isEmpty()
    row = timeline.detail("evt-1004", scene["events"].where("investigation_id = 'A'"), scene["occurrences"], scene["edges"], scene["related"]).first()
    assert {e.entity_key for e in row.entities} == {"ENG-PC-27", "FIN-SRV-02"} and any(r.derived for r in row.relationships)


def test_pivot_is_bounded_in_time(scene):
    edges = scene["edges"].where("investigation_id = 'D'")
    near = graph.around(edges, "FIN-SRV-02", "2026-09-18 10:05:00", 15)
    assert "OPS-PC-12" not in {r.neighbour for r in near.collect()}
    reached = {r.node: r for r in graph.reach(edges, "rahul", 2).collect()}
    assert reached["ENG-PC-27"].hop == 1 and reached["FIN-SRV-02"].hop == 2
    assert reached["FIN-SRV-02"].event_ids == ["evt-1004"] and reached["ENG-PC-27"].event_ids == ["evt-1000"]


def test_traversals_stay_in_their_investigation(spark):
    edge = "investigation_id string, relationship_type string, src_type string, src_key string, dst_type string, dst_key string, event_id string, at string"
    rows = [
        ("A", "CONNECTED_TO", "Host", "H1", "Server", "S", "e1", "2026-01-01 10:00:00"),
        ("B", "ACCESSED", "Server", "S", "File", "SECRET", "e2", "2026-01-01 10:01:00"),
        ("A", "ACCESSED", "Server", "S", "File", "OPEN", "e3", "2026-01-01 10:02:00"),
        ("A", "EXECUTED", "Host", "OPEN", "Process", "OPEN|sh", "e4", "2026-01-01 10:03:00"),
        ("A", "AUTHENTICATED_TO", "Host", "H1", "Server", "S", "e5", "2026-01-01 12:00:00"),
    ]
    edges = spark.createDataFrame(rows, edge).select("*", F.col("at").cast("timestamp").alias("timestamp"), F.array("event_id").alias("event_ids")).drop("at")
    names = lambda df: sorted((r.investigation_id, r.node_type, r.node, r.hop) for r in df.collect())
    assert names(graph.reach(edges, "H1", 3)) == [("A", "File", "OPEN", 2), ("A", "Server", "S", 1)]
    assert names(graph.reach(edges, "S", 1)) == [("A", "File", "OPEN", 1), ("A", "Host", "H1", 1), ("B", "File", "SECRET", 1)]
    assert names(graph.reach(edges, "S", 1, investigation_id="B")) == [("B", "File", "SECRET", 1)]
    # the file and the host that are both called OPEN are two nodes
    assert names(graph.reach(edges, "OPEN", 1, node_type="Host")) == [("A", "Process", "OPEN|sh", 1)]
    assert names(graph.reach(edges, "H1", 2, relationship_types=["CONNECTED_TO"])) == [("A", "Server", "S", 1)]
    assert names(graph.reach(edges, "H1", 2, start="2026-01-01 11:00:00")) == [("A", "Server", "S", 1)]
    assert names(graph.reach(edges, "H1", 2, entity_types=["File"])) == [("A", "File", "OPEN", 2)] and graph.reach(edges, "S", 2, limit=1).count() == 1
    assert [r.event_id for r in graph.hops(edges, "H1", 2).orderBy("hop", "event_id").collect()] == ["e1", "e5", "e3"]
    found = {(r.path, tuple(r.relationships), tuple(map(tuple, r.evidence))) for r in graph.paths(edges, "H1").collect()}
    assert found == {("H1 > S", ("CONNECTED_TO",), (("e1",),)), ("H1 > S", ("AUTHENTICATED_TO",), (("e5",),)), ("H1 > S > OPEN", ("CONNECTED_TO", "ACCESSED"), (("e1",), ("e3",))), ("H1 > S > OPEN", ("AUTHENTICATED_TO", "ACCESSED"), (("e5",), ("e3",)))}
    assert graph.neighbours(edges, "S", "B").count() == 1 and graph.pivot(edges, "server_files", investigation_id="B").first().end_key == "SECRET"
    assert {(r.investigation_id, r.relationship_type, r.n_edges) for r in graph.counts(edges).collect()} >= {("A", "ACCESSED", 1), ("B", "ACCESSED", 1)}
    for call in (graph.reach, graph.paths):
        with pytest.raises(cases.EngineError, match="depth"):
            call(edges, "H1", 8)
        assert call(edges, "H1", 8, max_depth=8).count() >= 2


def test_only_json_objects_and_arrays_are_nested(spark):
    base = {"event_type": "file", "action": "access", "timestamp": "2026-01-01T00:00:00Z"}
    rows = [("a", "[draft] plan.txt"), ("b", "{0A1B-2C}.tmp"), ("c", {"a": 1}), ("d", ["x"]), ("e", "[1]"), ("f", '{"a": 1}'), ("g", 7)]
    assert {r.event_id for r in make(spark, [base | {"event_id": i, "file": f} for i, f in rows]).collect()} == {"a", "b", "e", "f", "g"}
    vendor = [base | {"event_id": "v", "TargetFilename": {"x": 1}}, base | {"event_id": "w", "TargetFilename": "[w]"}]
    assert [r.event_id for r in make(spark, vendor).collect()] == ["w"]


def test_missing_ids_are_spread_and_never_duplicates(spark):
    raw = fixtures._raw(spark, [("t", '{"event_type":"x"}', "dataset", "test", str(k)) for k in range(50)])
    checked = ingest.ingest(raw)
    assert {tuple(e.message for e in r.errors) for r in checked.collect()} == {("event_id is required", "action is required", "timestamp is required")}


def test_accounts_are_one_user(spark):
    base = {"event_type": "authentication", "action": "login", "timestamp": "2026-01-01T00:00:00Z", "source_host": "H"}
    found = make(spark, [base | {"event_id": str(k), "user": u} for k, u in enumerate(["CORP\\rahul", "rahul", "Rahul@corp.example", " RAHUL "])])
    one = Rules(identity=Identity(user=account_key))
    assert {r.entity_key for r in extract.occurrences(found, rules=one).where("role = 'user'").collect()} == {"rahul"}
    assert {r.entity_key for r in extract.occurrences(found).where("role = 'user'").collect()} == {"rahul", "rahul@corp", "rahul@corp.example"}
    assert {r.user_domain for r in found.collect()} == {"CORP", None, "corp.example"} and "CORP\\rahul" in {r.user for r in found.collect()}
    full = Rules(identity=Identity(user=F.lower))
    assert {r.entity_key for r in extract.occurrences(found, rules=full).where("role = 'user'").collect()} == {"corp\\rahul", "rahul", "rahul@corp.example"}


def test_delta_candidates_join_new_keys_alone(spark):
    found = written(queries.events(spark, "/root/testdata/sf0.001"), "events")
    new = found.where("substr(event_id, 5) % 3 = 0")
    fresh = {r.event_id for r in new.collect()}
    rows = lambda df: {(r.a, r.b, tuple(r.kinds)) for r in df.collect()}
    want = {x for x in rows(correlate.candidates(found)) if x[0] in fresh or x[1] in fresh}
    got = correlate.candidates(found, new=new)
    assert rows(got) == want and got.count() == len(want) > 0


def test_loops_leave_one_round(spark):
    rounds = Rounds(spark)
    first = rounds.write(spark.range(3).toDF("x"))
    (path,) = rounds.paths
    second = rounds.write(first.selectExpr("x + 1 as x"))
    assert not exists(spark, path) and sorted(r.x for r in second.collect()) == [1, 2, 3]
    (path,) = rounds.paths
    rounds.clear()
    assert not exists(spark, path) and not remove(spark, shared_path(spark, "none"))


def test_base_tables_are_parsed_once(spark):
    plan = queries.tml_01_timeline(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "get_json_object" not in plan and "validated" in plan


def test_entity_detail_and_merge(spark, scene):
    entities = extract.entities(scene["occurrences"])
    row = graph.entity_detail(entities, scene["edges"], "A", "FIN-SRV-02").first()
    assert row.n_neighbours == 3 and row.observations == {"ACCESSED": 1, "CONNECTED_TO": 2} and row.n_events == 2
    merged = graph.merge_entities(entities, entities)
    assert merged.count() == entities.count() and merged.where("n_events <> size(event_ids)").isEmpty()


def test_sinks_keep_what_is_there(spark, tmp_path):
    folder = str(tmp_path)
    one = spark.createDataFrame([("i", 1)], "investigation_id string, x int")
    sinks.append(one, folder, "t")
    sinks.append(one.withColumn("y", F.lit(2)), folder, "t")
    assert sorted((r.x, r.y or 0) for r in sinks.load(spark, folder, "t", "i").collect()) == [(1, 0), (1, 2)] and sinks.load(spark, folder, "t", "none").isEmpty()
    days = spark.createDataFrame([("i", f"2024-01-{d:02d} 13:00:00") for d in (1, 5, 6, 20)] + [("j", "2024-01-02 00:00:00")], "investigation_id string, at string").withColumn("ingested_at", F.col("at").cast("timestamp"))
    sinks.append_by_day(days, folder, "d")
    assert sinks.purge(spark, folder, "d", 10, "2024-01-16 12:00:00") == 3
    left = sinks.load(spark, folder, "d")
    assert sorted(r.at[8:10] for r in left.collect()) == ["06", "20"]
    assert sinks.expired(left, 10, "2024-01-16 12:00:00").isEmpty() and sinks.retained(left, 1, "2024-01-16 12:00:00").count() == 1


def test_log_records_have_no_payload(caplog):
    durations = {}
    with caplog.at_level("INFO", "casewright"), measure.stage("parse", "r-1", "i-1", durations, "evt-1"):
        pass
    with pytest.raises(ZeroDivisionError), caplog.at_level("INFO", "casewright"), measure.stage("graph", "r-2", "i-1", durations):
        1 / 0
    logs = [json.loads(r.message) for r in caplog.records]
    assert [(x["request"], x["event"], x["stage"], x["success"]) for x in logs] == [("r-1", "evt-1", "parse", True), ("r-2", None, "graph", False)]
    assert set(logs[0]) == {"request", "investigation", "event", "stage", "success", "seconds"} and set(durations) == {"parse", "graph"}


def test_errors_tell_their_causes(spark, scene):
    grants = spark.createDataFrame([("ann", "A")], "user string, investigation_id string")
    cases.authorized(grants, "ann", "A")
    assert {r.investigation_id for r in cases.visible(scene["events"], grants, "ann").collect()} == {"A"}
    log = cases.create(spark, "t")
    calls = {
        401: lambda: cases.visible(log, grants, None),
        403: lambda: cases.authorized(grants, "ann", "B"),
        404: lambda: cases.change(log, "nowhere", status="CLOSED"),
        409: lambda: cases.require(log.where("1 = 0"), "case was changed meanwhile", 409),
        503: lambda: cases.guarded(lambda: 1 / 0, "graph store"),
        400: lambda: cases.change(log, log.first().investigation_id, title="  "),
    }
    for status, call in calls.items():
        with pytest.raises(cases.EngineError) as e:
            call()
        assert e.value.envelope()["status"] == status and e.value.envelope()["error"] == cases.EngineError.CODES[status]
    with pytest.raises(cases.EngineError) as e:
        cases.guarded(lambda: cases.require(log.where("1 = 0"), "case"), "store")
    assert e.value.status == 404 and cases.require(log, "case").count() == 1


def test_notes_and_ties_of_cases(spark):
    n = cases.note(spark, "i", "look at this", "ann").first()
    assert (n.note, n.author, n.kind) == ("look at this", "ann", "analyst")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    log = cases.opened(spark.createDataFrame([("i", "t")], "investigation_id string, title string"), at)
    later = F.lit("2026-01-02 00:00:00").cast("timestamp")
    log = written(log.unionByName(cases.change(log, "i", later, status="CLOSED")).unionByName(cases.change(log, "i", later, status="UNDER_REVIEW")), "log")
    assert cases.latest(log).first().status == "CLOSED"


def test_malformed_csv_lines_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("event_id,n\ne1,5\ne2,five\ne3,6,7\n")
    rows = sorted(r.raw for r in adapters.csv_rows(spark, str(tmp_path / "a.csv"), "event_id string, n int").collect())
    assert rows == ["e2,five", "e3,6,7", '{"event_id":"e1","n":5}']
    rejected = ingest.rejected_events(ingest.ingest(adapters.stamp(adapters.csv_rows(spark, str(tmp_path / "a.csv"), "event_id string, n int"), "i", "dataset", "csv")))
    assert {r.raw for r in rejected.where("error = 'PARSE_ERROR'").collect()} == {"e2,five", "e3,6,7"}


def test_context_summary_and_grounding(spark, scene):
    a = lambda df: df.where("investigation_id = 'A'")
    events, edges = a(scene["events"]), a(scene["edges"])
    entities = written(extract.entities(a(scene["occurrences"])), "entities")
    row = context.context("case", timeline.timeline(events, edges), entities, extract.relationships(edges), a(scene["related"]), graph.paths(edges, "rahul"))
    provider = context.TemplateProvider()
    done = context.summarize(row, provider)
    assert done["status"] == "available" and all(f"## {s}" in done["summary"] for s in context.SECTIONS)
    assert done["context"]["prompt"] == context.PROMPT and "path rahul > ENG-PC-27" in done["summary"] and len(json.loads(done["context"]["paths"])) >= 5
    stored = context.audit("A", done, provider, spark)
    assert stored.first().kind == "narrative" and json.loads(stored.first().context)["description"] == "case"
    own = context.statements_of(stored)
    verdicts = {r.verdict for r in context.grounding(own, events, entities=entities).collect()}
    assert own.count() > 5 and "invented" not in verdicts
    marked = timeline.with_narrative(timeline.timeline(events, edges), stored)
    assert {r.kind: r.n for r in marked.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"event": 4, "narrative": 1}

    class Broken(context.SummaryProvider):
        def generate_summary(self, context):
            raise RuntimeError("no provider")

    failed = context.audit("A", context.summarize(row, Broken()), Broken(), spark).first()
    assert (failed.status, failed.summary, failed.error) == ("unavailable", None, "no provider")
    odd = spark.createDataFrame([(1, "Rahul ran powershell.exe (evt-1002)"), (2, "user77 ran it (evt-1002)"), (3, "evil.exe (evt-1002)")], "statement_id int, text string")
    checked = context.grounding(odd, events, entities=entities)
    assert {r.statement_id: r.verdict for r in checked.collect()} == {1: "grounded", 2: "invented", 3: "invented"}
    tally = {r.measure: r.n for r in context.grounding_tally(checked, events, odd).collect()}
    assert tally == {"supported": 1, "unsupported": 0, "incorrect": 2, "missing evidence": 3}
    said = spark.createDataFrame([(1, "login (evt-1000)"), (2, "then evt-9999"), (3, "nothing")], "statement_id int, text string")
    assert {r.statement_id: r.verdict for r in context.grounding(said, events).collect()} == {1: "grounded", 2: "invented", 3: "unsupported"}


def test_cases(spark):
    log = written(cases.create(spark, "title"), "cases")
    inv = log.first().investigation_id
    log = log.unionByName(cases.change(log, inv, F.expr("timestamp'2999-01-01'"), status="CLOSED", outcome="ESCALATE"))
    now = cases.latest(log).first()
    assert now.status == "CLOSED" and now.outcome == "ESCALATE" and now.closed_at is not None
    with pytest.raises(cases.EngineError):
        cases.create(spark, " ")
    with pytest.raises(cases.EngineError):
        cases.change(log, inv, status="LOST")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("event_id,user\ne1,Rahul\ne2,\n")
    rows = sorted(r.raw for r in adapters.csv_rows(spark, str(tmp_path / "a.csv"), "event_id string, user string").collect())
    assert rows == ['{"event_id":"e1","user":"Rahul"}', '{"event_id":"e2"}']
    bodies = spark.createDataFrame([('[{"a":1},{"a":2}]',), ("{bad",)], "body string")
    assert adapters.json_array(bodies).count() == 3
    with pytest.raises(ValueError):
        adapters.stamp(adapters.json_event(spark, "{}"), "i", "unknown", "x")


def test_stream_equals_batch(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    late = fixtures.event("z", "23:59:00", "x", "login", user="nobody")
    (folder / "a.json").write_text("\n".join(json.dumps({k: v for k, v in e.items() if k != "source"}) for e in [*fixtures.A, fixtures.A[0], late]))
    raw = adapters.stamp(adapters.stream_lines(spark, str(folder)), "A", "simulation", "s")
    query = streams.ingest(raw).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(out))
    query.awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(str(out)).collect()) == ["evt-1000", "evt-1002", "evt-1004", "evt-1006", "z"]
