"""Patterns, routes, chains, streams' state and stores, sources, segments and declared entities against plain versions and on awkward rows."""

import json
import random
import shutil
import subprocess
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casewright.functions import fields
from casewright.operators import cases, context, correlate, evidence, expanded, extract, ingest, measure, patterns, routes, timeline
from casewright.sources import adapters, sinks
from casewright.sources.lines import EventLines
from casewright.streaming import events as streams
from casewright.streaming.store import GraphStore

EVENT = "investigation_id string, event_id string, at double, action string, user string, source_host string, destination_host string, source_ip string, destination_ip string, process string, file string"
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


def frame(spark, rows):
    """Events of dictionaries; ``at``: seconds."""
    data = [tuple(float(r[c]) if c == "at" else r.get(c, "i" if c == "investigation_id" else None) for c in COLUMNS) for r in rows]
    return spark.createDataFrame(data, EVENT).withColumns({"timestamp": F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint")), "source_name": F.lit("test"), "raw_data": F.lit("{}")}).drop("at")


def raw(spark, rows, inv="i", ingested="2026-01-01 00:00:00"):
    data = [(inv, r if isinstance(r, str) else json.dumps(r), "dataset", "t", str(k)) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, "investigation_id string, raw string, source_type string, source_name string, source_record_id string").withColumn("ingested_at", F.lit(ingested).cast("timestamp"))


def stamp(seconds):
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(seconds + 1_767_225_600))


# --- ids, deliveries, names


def test_ids_of_any_look_are_kept_and_purged(spark, tmp_path):
    folder = str(tmp_path)
    ids = ["007", "case:1", "7", "2024-01-01", "a/b c"]
    rows = spark.createDataFrame([(i, d) for i in ids for d in (1, 20)], "investigation_id string, d int").withColumn("ingested_at", F.make_timestamp(F.lit(2024), F.lit(1), "d", F.lit(5), F.lit(0), F.lit(0)))
    sinks.append_by_day(rows, folder, "t")
    assert {r.investigation_id for r in sinks.load(spark, folder, "t").collect()} == set(ids)
    assert all(sinks.load(spark, folder, "t", i).count() == 2 for i in ids)
    assert sinks.purge(spark, folder, "t", 10, "2024-01-16 12:00:00") == len(ids)
    assert sorted((r.investigation_id, r.d) for r in sinks.load(spark, folder, "t").collect()) == sorted((i, 20) for i in ids)
    assert sinks.purge(spark, folder, "t", 10, "2024-01-16 12:00:00") == 0 == sinks.purge(spark, folder, "none", 1, "2024-01-16")
    with pytest.raises(Exception, match="investigation_id is required"):
        sinks.append(rows.withColumn("investigation_id", F.lit(" ")), folder, "t")


def test_a_damaged_delivery_takes_no_id(spark):
    good = {"event_id": "e", "event_type": "x", "action": "login", "timestamp": "2026-01-01T00:00:00Z"}
    rows = [good | {"timestamp": "nope"}, good, good | {"action": "logout"}, good | {"event_id": "f"}, good | {"event_id": "f", "action": None}]
    checked = ingest.ingest(raw(spark, rows))
    assert {(r.event_id, r.action) for r in ingest.security_events(checked).collect()} == {("e", "login"), ("f", "login")}
    assert sorted((r.event_id, r.message) for r in ingest.rejected_events(checked).collect()) == [("e", "event_id occurs already"), ("e", "timestamp is malformed"), ("f", "action is required")]


def test_names_without_a_name_have_no_key(spark):
    cases_ = [("D1\\admin", "admin@d1"), ("D2\\Admin", "admin@d2"), ("admin", "admin"), ("admin@D1", "admin@d1"), ("@a.example", None), ("D1\\", None), ("D1\\ ", None), ("", None), (None, None)]
    got = spark.createDataFrame(cases_, "user string, want string").select("want", fields.user_key(F.col("user")).alias("key"), fields.account_key(F.col("user")).alias("account")).collect()
    assert all(r.want == r.key for r in got) and {r.account for r in got} == {"admin", None}
    paths = [("C:\\bin\\", None), ("/usr/bin/", None), ("C:\\bin\\a.exe", "H|a.exe"), ("a.exe", "H|a.exe"), ("", None), (None, None)]
    got = spark.createDataFrame(paths, "path string, want string").select("want", fields.process_key(F.lit("h"), F.col("path")).alias("key")).collect()
    assert all(r.want == r.key for r in got)
    found = frame(spark, [{"event_id": "1", "at": 0, "action": "login", "user": "@x", "source_host": "H"}, {"event_id": "2", "at": 1, "action": "login", "user": "D\\", "source_host": "G", "process": "C:\\"}])
    assert {r.role for r in extract.occurrences(found).collect()} == {"source_host"} and correlate.candidates(found).isEmpty()


# --- busy entities


def test_derived_edges_of_a_busy_host_are_linear(spark):
    rows = spark.range(100_000).selectExpr("'i' investigation_id", "concat('e', id) event_id", "timestamp_micros(id * 5000) timestamp", "if(id % 3 = 0, 'execute', 'connect') action", "'H' source_host", "cast(null as string) user", "concat('S', id % 9) destination_host", "cast(null as string) destination_ip", "if(id % 3 = 0, concat('p', id), null) process", "'t' source_name")
    began = time.time()
    found = extract.derived_edges(rows)
    assert found.count() == 66_666 and time.time() - began < 40  # 500 seconds of one host: one bucket of the window
    sample = found.where("event_id in ('e1', 'e50000', 'e99998')").collect()
    assert {r.event_id: r.event_ids[0] for r in sample} == {"e1": "e0", "e50000": "e49998" if 49998 % 3 == 0 else "e49999", "e99998": "e99996"}


def test_derived_edges_end_with_the_window(spark):
    ex = lambda i, at: {"event_id": i, "at": at, "action": "execute", "source_host": "h", "process": f"p{i}"}
    co = lambda i, at: {"event_id": i, "at": at, "action": "connect", "source_host": "H", "destination_host": "S"}
    found = extract.derived_edges(frame(spark, [ex("a", 100), co("b", 700), co("c", 700.000001), ex("d", 1300), co("e", 1300), co("f", 1899), co("g", 5000)]))
    assert {(r.event_ids[0], r.event_id) for r in found.collect()} == {("a", "b"), ("d", "e"), ("d", "f")}


def random_events(rng, n, span):
    pick = lambda values: rng.choice(values + [None])
    hosts = ["H1", "h1", "H2", "S-SRV-1", "H3"]
    return [
        {"event_id": f"e{k:03d}", "at": rng.randrange(span), "action": rng.choice(["login", "execute", "connect", "access"]), "user": pick(["u", "U", "v", "w"]), "source_host": pick(hosts), "destination_host": pick(hosts),
         "source_ip": pick(["1", "2", "3"]), "destination_ip": pick(["1", "2", "3", "4"]), "process": pick(["p", "q"]), "file": pick(["f", "g", "k"])}
        for k in range(n)
    ]


def members(pairs):
    """Components of pairs, each as a set."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out, seen = set(), set()
    for node in near:
        if node not in seen:
            group, todo = set(), [node]
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += near[x]
            seen |= group
            out.add(frozenset(group))
    return out


@pytest.mark.parametrize("seed,n,span", [(1, 60, 20_000), (2, 40, 60_000), (3, 80, 9_000)])
def test_chain_links_have_the_components_of_all_pairs(spark, seed, n, span):
    found = frame(spark, random_events(random.Random(seed), n, span))
    related = [(r.event_a, r.event_b) for r in correlate.correlations(correlate.candidates(found), found).where("related").collect()]
    links = correlate.chain_links(found).collect()
    assert members(related) == members((r.event_a, r.event_b) for r in links)
    assert len({(r.event_b, r.kind) for r in links}) >= len(links) / 2 and len(links) <= 9 * n  # an event has one link an identifier


def test_chain_links_of_a_hub_run(spark):
    rows = spark.range(100_000).selectExpr("'i' investigation_id", "concat('e', id) event_id", "timestamp_micros(id * 5000) timestamp", "'HUB' source_host", "'HUB' destination_host", *[f"cast(null as string) {c}" for c in ("user", "source_ip", "destination_ip", "process", "file")])
    links = correlate.chain_links(rows)
    assert 2 * 99_999 <= links.count() <= 3 * 100_000


def plain_matches(rows, pattern, key):
    """Each first event with the next event for each further step, by looking through all that follow."""
    states = pattern.states()
    by = defaultdict(list)
    for r in rows:
        if r.get(key) is not None:
            by[r[key].upper()].append(r)
    out = Counter()
    for name, events in by.items():
        events.sort(key=lambda r: (r["at"], r["event_id"]))
        for k, first in enumerate(events):
            if first["action"] != states[0].when:
                continue
            at, ids = k, [first["event_id"]]
            for s in states[1:]:
                nxt = next((j for j in range(at + 1, len(events)) if events[j]["action"] == s.when), None)
                if nxt is None or events[nxt]["at"] - events[at]["at"] > s.within or s.unless and any(events[j]["action"] == s.unless for j in range(at + 1, nxt)):
                    break
                at = nxt
                ids.append(events[nxt]["event_id"])
            else:
                if pattern.most is None or events[at]["at"] - first["at"] <= pattern.most:
                    out[name, tuple(ids)] += 1
    return out


@pytest.mark.parametrize("seed", range(2))
def test_patterns_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    rows = [{"event_id": f"e{k:03d}", "at": rng.randrange(0, 3000, 5), "action": rng.choice("abcd"), "source_host": rng.choice(["H", "G", None])} for k in range(250)]
    found = frame(spark, rows)
    step = lambda n, within=600, times=1, unless=None: (n, within, times, unless)
    shapes = [[step("a"), step("b")], [step("a"), step("a", 60), step("b", 30, 2, "c")], [step("a", times=3), step("d", 100, unless="b")], [step("c")], [step("b"), step("c", 0), step("d", 200)]]
    for steps in shapes:
        for most in (None, 80):
            sql = patterns.Pattern("p", "host", tuple(patterns.Step(n, f"action = '{n}'", w, t, u and f"action = '{u}'") for n, w, t, u in steps), most)
            plain = patterns.Pattern("p", "host", tuple(patterns.Step(n, n, w, t, u) for n, w, t, u in steps), most)
            got = Counter((r.entity_key, tuple(r.event_ids)) for r in patterns.matches(found, sql).collect())
            assert got == plain_matches(rows, plain, "source_host"), (steps, most)


def test_patterns_of_a_hub_and_of_nothing(spark):
    hub = spark.range(60_000).selectExpr("'i' investigation_id", "concat('e', id) event_id", "timestamp_micros(id * 1000000) timestamp", "if(id % 2 = 0, 'a', 'b') action", "'HUB' source_host", *[f"cast(null as string) {c}" for c in ("user", "destination_host", "source_ip", "destination_ip", "process", "file")])
    pattern = patterns.Pattern("p", "host", (patterns.Step("a", "action = 'a'"), patterns.Step("b", "action = 'b'", 10), patterns.Step("a", "action = 'a'", 10)))
    found = patterns.matches(hub, pattern)
    assert found.count() == 29_999 and patterns.matches(hub.limit(0), pattern).isEmpty()
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    assert patterns.matches(hub.withColumn("timestamp", F.lit(None).cast("timestamp")), pattern).isEmpty()
    with pytest.raises(ValueError):
        patterns.matches(hub, patterns.Pattern("p", "host", ()))


# --- routes


def brute_routes(rows, start, end, depth, directed):
    """(hops, arrival) that no other has both at least as good, over all walks whose hops follow one another in time."""
    links = [(t, a, b) for t, a, b in rows] + ([] if directed else [(t, b, a) for t, a, b in rows])
    best, now = [], {start: -1}
    for hop in range(1, depth + 1):
        after = {}
        for t, a, b in links:
            if a in now and now[a] <= t and b != start:
                after[b] = min(after.get(b, t), t)
        now = after
        if end in now and all(now[end] < t for _, t in best):
            best.append((hop, now[end]))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_routes_equal_a_search_of_all_walks(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(100), rng.randrange(7), rng.randrange(7)) for _ in range(40)]
    rows = [(t, a, b) for t, a, b in rows if a != b]
    data = [("i", f"e{k}", t, "R", "N", f"n{a}", "N", f"n{b}") for k, (t, a, b) in enumerate(rows)] + [("other", "x", 0, "R", "N", "n0", "N", "n6")]
    edges = spark.createDataFrame(data, "investigation_id string, event_id string, t int, relationship_type string, src_type string, src_key string, dst_type string, dst_key string").withColumns({"timestamp": F.timestamp_seconds("t"), "event_ids": F.array("event_id")})
    for directed, depth in ((True, 6), (False, 4), (False, 1)):
        got = routes.routes(edges, "n0", "N", "n6", "N", depth, investigation_id="i", directed=directed).orderBy("hops").collect()
        assert [(r.hops, r.arrives.timestamp()) for r in got] == [(h, float(t)) for h, t in brute_routes(rows, 0, 6, depth, directed)]
        for r in got:  # each hop is an observation, in order of time, and they join up
            assert r.times == sorted(r.times) and len(r.nodes) == r.hops + 1 and r.nodes[0] == "N:n0" and r.nodes[-1] == "N:n6"
            for a, b, t, ids in zip(r.nodes, r.nodes[1:], r.times, r.evidence):
                at, x, y = rows[int(ids[0][1:])]
                assert at == t.timestamp() and {f"N:n{x}", f"N:n{y}"} == {a, b}
    assert routes.routes(edges, "n0", "N", "n0", "N", 3).isEmpty() and routes.routes(edges, "n0", "N", "nowhere", "N", 3).isEmpty()
    assert {r.investigation_id for r in routes.routes(edges, "n0", "N", "n6", "N", 2).collect()} >= {"other"}
    with pytest.raises(cases.EngineError, match="depth"):
        routes.routes(edges, "n0", "N", "n6", "N", 11)


# --- streams


def test_streamed_derived_edges_of_shuffled_arrivals(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for k in range(160):
        act = rng.choice(["execute", "connect"])
        rows.append({"event_id": f"e{k:03d}", "event_type": "x", "action": act, "timestamp": stamp(rng.randrange(0, 3000)), "source_host": rng.choice(["a", "B"]), **({"process": rng.choice("pq")} if act == "execute" else {"destination_host": "S-SRV-1"})})
    end = {"event_id": "end", "event_type": "x", "action": "end", "timestamp": "2030-01-01T00:00:00Z", "source_host": "z"}
    spark.conf.set(*streams.STATE_CONF)
    folder = tmp_path / "in"
    folder.mkdir()
    for k, batch in enumerate([rows[0::3], rows[1::3], rows[2::3], [end]]):  # each batch holds times of the whole span
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, batch)))
        lines = adapters.stamp(adapters.stream_lines(spark, str(folder), 1), "i", "simulation", "s")
        q = streams.derived_edges(streams.ingest(lines, delay="2 hours")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
    got = {(r.event_id, r.exec_event_id, r.src_key) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = extract.derived_edges(ingest.security_events(ingest.ingest(raw(spark, rows))))
    assert got == {(r.event_id, r.event_ids[0], r.src_key) for r in batch.collect()} and len(got) > 50


def test_dropped_rows_are_counted(spark, tmp_path):
    base = {"event_type": "x", "action": "login", "source_host": "H"}
    folder = tmp_path / "in"
    folder.mkdir()
    for k, times in enumerate([[0, 10], [90_000], [5, 6, 7, 90_001], [200_000]]):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(base | {"event_id": f"{k}-{t}", "timestamp": stamp(t)}) for t in times))
        lines = adapters.stamp(adapters.stream_lines(spark, str(folder), 1), "i", "simulation", "s")
        q = streams.ingest(lines).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        assert streams.dropped_rows(q) == (3 if k == 2 else 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_primitives_of_unknown_members(spark):
    texts = ['{"a":5,"b":"5","c":1.5,"d":1e3,"e":true,"f":null,"g":{"x":[1]},"h":"2024-01-01T00:00:00Z","i":"2024-13-01T00:00:00Z","user":"u"}', "{bad", "[1]", '"x"', "7", "", '{"event_id":"e"}', '{"a":12345678901234567890,"a b":"t"}']
    got = sorted((r.source_record_id, r.name, r.kind, r.whole, r.number, r.flag, str(r.moment), r.text) for r in ingest.primitives(raw(spark, texts)).collect())
    none = "None"
    assert got == [
        ("0", "a", "BIGINT", 5, None, None, none, None), ("0", "b", "STRING", None, None, None, none, "5"), ("0", "c", "NUMBER", None, 1.5, None, none, None), ("0", "d", "NUMBER", None, 1000.0, None, none, None),
        ("0", "e", "BOOLEAN", None, None, True, none, None), ("0", "f", "VOID", None, None, None, none, None), ("0", "g", "OBJECT", None, None, None, none, '{"x":[1]}'), ("0", "h", "TIMESTAMP", None, None, None, "2024-01-01 00:00:00", None), ("0", "i", "STRING", None, None, None, none, "2024-13-01T00:00:00Z"),
        ("7", "a", "NUMBER", None, 1.2345678901234567e19, None, none, None), ("7", "a b", "STRING", None, None, None, none, "t"),
    ]


def test_adjacent_across_spans(spark):
    rng = random.Random(2)
    rows = [{"event_id": f"e{k:03d}", "at": rng.randrange(0, 400_000), "action": "x", "user": rng.choice(["u", "U", "v", None])} for k in range(120)]
    got = {r.event_id: (r.before, r.after) for r in timeline.adjacent(frame(spark, rows), 3600).collect()}
    want = {r["event_id"]: (None, None) for r in rows}
    for user in "uv":
        own = [r["event_id"] for r in sorted((r for r in rows if (r["user"] or "").lower() == user), key=lambda r: (r["at"], r["event_id"]))]
        want |= {i: (own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None) for k, i in enumerate(own)}
    assert got == want


def test_a_store_shows_committed_batches_alone(spark, tmp_path):
    base = {"event_type": "x", "action": "login", "timestamp": "2026-01-01T00:00:00Z", "source_host": "H"}
    one = raw(spark, [base | {"event_id": f"e{k}", "user": f"u{k % 2}"} for k in range(4)] + ["{bad"], inv="007").withColumn("late", F.lit(False))
    two = raw(spark, [base | {"event_id": "e1", "user": "u1"}, base | {"event_id": "e9", "user": "U1", "timestamp": "2025-12-31T00:00:00Z"}, base | {"event_id": "e10", "user": "u1"}], inv="007").withColumn("late", F.get_json_object("raw", "$.event_id") == "e10")
    store = GraphStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="no batch"):
        store.table("security_events")
    store.write_batch(one, 0)
    for _ in range(2):  # the same batch again changes nothing
        store.write_batch(two, 1)
        assert sorted(r.event_id for r in store.table("security_events").collect()) == ["e0", "e1", "e2", "e3", "e9"]
        assert Counter(r.error for r in store.table("rejected_events").collect()) == {"PARSE_ERROR": 1, "VALIDATION_ERROR": 1, "LATE_EVENT": 1}
        users = {r.entity_key: (r.n_events, r.name, str(r.first_seen)) for r in store.entities().where("entity_type = 'User'").collect()}
        assert users == {"u0": (2, "u0", "2026-01-01 00:00:00"), "u1": (3, "U1", "2025-12-31 00:00:00")}
        assert {r.src_key: r.n for r in store.relationships().collect()} == {"u0": 2, "u1": 3}
        store.compact()
    assert {(r.batch_id, r.metric, r.n) for r in store.table("metrics").collect()} == {(0, "input", 5), (0, "valid", 4), (0, "rejected", 1), (1, "input", 3), (1, "valid", 1), (1, "rejected", 2)}
    shutil.copytree(tmp_path / "s" / "security_events" / "batch=0", tmp_path / "s" / "security_events" / "batch=2")  # a batch that never committed
    assert store.table("security_events").count() == 5 and {r.investigation_id for r in store.entities().collect()} == {"007"}


def test_a_late_row_takes_no_id_and_commits_are_folded(spark, tmp_path):
    base = {"event_type": "x", "action": "login", "source_host": "H", "user": "u"}
    store = GraphStore(spark, str(tmp_path / "s"))
    for batch in range(4):
        rows = [base | {"event_id": f"b{batch}", "timestamp": stamp(batch)}, base | {"event_id": "late-first", "timestamp": stamp(0)}, base | {"event_id": "late-first", "timestamp": stamp(900 + batch)}]
        store.write_batch(raw(spark, rows).withColumn("late", F.get_json_object("raw", "$.timestamp") == stamp(0)), batch)
        if batch == 2:
            store.compact()
    # the first batch's own event is late as well; of the repeated one the first delivery in time stays
    assert {(r.event_id, str(r.timestamp)[14:]) for r in store.table("security_events").collect()} == {("b1", "00:01"), ("b2", "00:02"), ("b3", "00:03"), ("late-first", "15:00")}
    assert Counter((r.event_id, r.error) for r in store.table("rejected_events").collect()) == {("b0", "LATE_EVENT"): 1, ("late-first", "LATE_EVENT"): 4, ("late-first", "VALIDATION_ERROR"): 3}
    assert store.last() == 3 and len(list((tmp_path / "s" / "commits").glob("batch=*"))) == 2
    assert [(r.entity_key, r.n_events) for r in store.entities().where("entity_type = 'User'").collect()] == [("u", 4)]


# --- sources


def test_line_source_cuts_files_anywhere(spark, tmp_path):
    folder = tmp_path / "d"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.json").write_bytes(b'{"a":1}\r\n\n   \n{bad\n' + "é漢\n".encode() * 20 + b"no end")
    (folder / "sub" / "b.json").write_bytes(b"\n\nx\n")
    (folder / "_SUCCESS").write_bytes(b"not data")
    (folder / "empty").write_bytes(b"")
    spark.dataSource.register(EventLines)
    want = sorted(r.raw for r in adapters.json_lines(spark, str(folder / "a.json")).collect()) + ["x"]
    for size in (1, 3, 7, 1000):
        rows = spark.read.format("event_lines").option("range_bytes", size).load(str(folder)).collect()
        assert sorted(r.raw for r in rows) == sorted(want)
        assert all(Path(r.path).read_bytes()[r.offset :].startswith(r.raw.encode()) for r in rows)
    out = str(tmp_path / "out")

    def drain():
        q = spark.readStream.format("event_lines").load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        return sorted(r.raw for r in spark.read.parquet(out).collect())

    assert drain() == sorted(want)
    time.sleep(0.05)
    (folder / "c.json").write_bytes(b"later\n")
    assert drain() == sorted([*want, "later"])  # the files before are not read again
    with pytest.raises(Exception, match="path"):
        spark.read.format("event_lines").load().count()


# --- segments, declared entities, mentions, counts


def test_segments_are_bounded_and_whole(spark):
    rows = spark.range(5000).selectExpr("'i' investigation_id", "'User' entity_type", "if(id % 10 < 8, 'hub', concat('u', id % 3)) entity_key", "concat('e', id) event_id", "timestamp_seconds(id * 60) timestamp")
    rows = rows.unionByName(rows.where("event_id in ('e1', 'e2')").withColumn("timestamp", F.col("timestamp") + F.expr("interval 3 days"))).unionByName(rows.limit(1).withColumn("event_id", F.lit(None).cast("string")))
    found = evidence.segments(rows, evidence.ENTITY, size=50).cache()
    assert found.agg(F.max("n")).first()[0] < 110 and found.agg(F.sum("n")).first()[0] == 5000
    index = {r.entity_key: r for r in evidence.heads(found, evidence.ENTITY).collect()}
    assert index["hub"].n_events == 4000 and index["hub"].n_segments > 70 and sum(r.n_events for r in index.values()) == 5000
    asked = spark.createDataFrame([("i", "User", "u0")], "investigation_id string, entity_type string, entity_key string")
    assert evidence.events_of(found, evidence.ENTITY, asked).count() == index["u0"].n_events
    assert 0 < evidence.events_of(found, evidence.ENTITY, end="1970-01-01 12:00:00").count() < 5000
    edges = spark.createDataFrame([("i", "R", "A", "a", "B", "b", ["x", "y"], 5), ("i", "R", "A", "a", "B", "b", ["y", "z"], 6)], "investigation_id string, relationship_type string, src_type string, src_key string, dst_type string, dst_key string, event_ids array<string>, t int").withColumn("timestamp", F.timestamp_seconds("t"))
    assert evidence.segments(edges, evidence.EDGE).first().event_ids == ["x", "y", "z"]


def test_declared_entities(spark):
    events = frame(spark, [{"event_id": str(k), "at": k, "action": "login", "user": "U", "source_host": h} for k, h in enumerate(["h", None, "h", "h", "h"])])
    texts = ['{"s":{"id":"A"},"r":["k1"]}', '{"s":{"id":"A"}}', '{"s":{"id":" "},"r":[{"x":1}]}', "no json", '{"s":7,"r":[5]}']
    events = events.withColumn("raw_data", F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("event_id").cast("int") + 1))
    types = spark.createDataFrame([("Session", "$.s.id", "session", "lower@source_host"), ("Key", "$.r[0]", "key", "upper")], expanded.ENTITIES)
    got = sorted((r.event_id, r.entity_type, r.entity_key, r.name) for r in expanded.occurrences(events, types).collect())
    assert got == [("0", "Key", "K1", "k1"), ("0", "Session", "H|a", "A"), ("4", "Key", "5", "5")]
    kinds = spark.createDataFrame([("OPENED", "user", "session", "login"), ("TOUCHED", "session", "key", None), ("OFF", "user", "key", "logout")], expanded.EDGES)
    assert sorted((r.relationship_type, r.src_key, r.dst_type, r.dst_key) for r in expanded.observations(events, types, kinds).collect()) == [("OPENED", "u", "Session", "H|a"), ("TOUCHED", "H|a", "Key", "K1")]
    assert expanded.occurrences(events, types.limit(0)).isEmpty() and expanded.observations(events, types, kinds.limit(0)).isEmpty()
    for bad in ([("S", "$.s", "user", "plain")], [("S", "$.s", "x", "wrong")], [("S", "$.s", "x", "plain@y")], [("S", "$.s", "x", "plain"), ("T", "$.t", "x", "plain")]):
        with pytest.raises(cases.EngineError):
            expanded.occurrences(events, spark.createDataFrame(bad, expanded.ENTITIES))


def test_mentions_need_no_pattern(spark):
    entities = spark.createDataFrame([("i", "Backup Service", "backup service"), ("i", "was", "was"), ("i", "Very Long Name of Some Thing", None), ("j", "Zed", "zed")], "investigation_id string, name string, entity_key string")
    events = spark.createDataFrame([("i", "ev#1"), ("j", "ev#2")], "investigation_id string, event_id string")
    words = spark.createDataFrame([(w,) for w in "the backup ran on was by very long and".split()], "word string")
    said = [("i", 1, "The Backup Service ran (ev#1)."), ("i", 2, "The backup ran by Zed, ev#1"), ("i", 3, "very long name of some thing ran ev#1"), ("i", 4, "Very long name ran"), ("i", 5, "ev#2 was"), ("j", 6, "Zed ran: ev#2"), ("i", 7, None), ("i", 8, "the ran")]
    found = context.mentions(spark.createDataFrame(said, "investigation_id string, statement_id int, text string"), events, entities, words)
    got = defaultdict(set)
    for r in found.collect():
        got[r.statement_id].add((r.kind, r.item))
    assert got == {1: {("entity", "backup service"), ("event", "ev#1")}, 2: {("unknown", "zed"), ("event", "ev#1")}, 3: {("entity", "very long name of some thing"), ("event", "ev#1")}, 4: {("unknown", "name")}, 5: {("unknown", "ev#2"), ("entity", "was")}, 6: {("entity", "zed"), ("event", "ev#2")}}
    verdicts = context.grounded_statements(spark.createDataFrame(said, "investigation_id string, statement_id int, text string"), found)
    assert {r.statement_id: r.verdict for r in verdicts.collect()} == {1: "grounded", 2: "invented", 3: "grounded", 4: "invented", 5: "invented", 6: "grounded", 7: "unsupported", 8: "unsupported"}


def test_counts_come_with_the_write(spark, tmp_path):
    seen = measure.write_observed(spark.range(100), str(tmp_path / "x"), "x", {"odd": F.count_if(F.col("id") % 2 == 1)})
    assert (seen["rows"], seen["odd"]) == (100, 50) and seen["seconds"] > 0 and spark.read.parquet(str(tmp_path / "x")).count() == 100


def test_a_leftover_folder_is_no_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "casewright", tmp_path / "casewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "casewright" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(q.startswith('op') for q in e.queries()); print(len(e.oracle_sql()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{':'.join(p for p in sys.path if 'site-packages' in p)}"}).stdout) > 60
