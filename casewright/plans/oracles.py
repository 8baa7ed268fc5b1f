"""DuckDB SQL of the engine's queries."""

from __future__ import annotations

STAMP = "'%Y-%m-%d %H:%M:%S.%f'"

SE = """
k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
se AS (SELECT 'evt-' || event_id AS event_id, ts AS t, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp",
  CASE event_type WHEN 'signup' THEN 'authentication' WHEN 'view' THEN 'authentication' WHEN 'click' THEN 'process' WHEN 'purchase' THEN 'network' ELSE 'file' END AS event_type,
  CASE event_type WHEN 'signup' THEN 'authenticate' WHEN 'view' THEN 'login' WHEN 'click' THEN 'execute' WHEN 'purchase' THEN 'connect' ELSE 'access' END AS action,
  'user' || user_id AS "user",
  CASE WHEN event_type = 'error' THEN 'FIN-SRV-0' || (k % 5) ELSE 'ENG-PC-' || lpad(CAST(k % 20 AS VARCHAR), 2, '0') END AS source_host,
  CASE WHEN event_type = 'purchase' AND k % 4 <> 0 OR event_type = 'view' AND k % 7 = 3 THEN 'FIN-SRV-0' || (k % 5) END AS destination_host,
  CASE WHEN event_type IN ('signup', 'view') THEN '10.1.0.' || (k % 20) END AS source_ip,
  CASE WHEN event_type = 'purchase' AND k % 4 = 0 THEN '10.0.0.' || (k % 5) END AS destination_ip,
  CASE WHEN event_type = 'click' THEN ['powershell.exe', 'cmd.exe', 'python.exe', 'bash'][k % 4 + 1] END AS process,
  CASE WHEN event_type = 'error' THEN 'file_' || k || '.dat' END AS file, CAST(NULL AS VARCHAR) AS severity
  FROM k),
kind AS (SELECT *, CASE WHEN contains(source_host, '-SRV-') THEN 'Server' ELSE 'Host' END AS src_kind, coalesce(destination_host, destination_ip) AS far,
  CASE WHEN destination_host IS NULL THEN 'IP' WHEN contains(destination_host, '-SRV-') THEN 'Server' ELSE 'Host' END AS far_kind, source_host || '|' || process AS process_key FROM se),
occ AS (
  SELECT event_id, t, 'User' AS entity_type, lower("user") AS entity_key, "user" AS name, 'user' AS role FROM kind
  UNION ALL SELECT event_id, t, src_kind, upper(source_host), source_host, 'source_host' FROM kind
  UNION ALL SELECT event_id, t, far_kind, upper(destination_host), destination_host, 'destination_host' FROM kind WHERE destination_host IS NOT NULL
  UNION ALL SELECT event_id, t, 'IP', source_ip, source_ip, 'source_ip' FROM kind WHERE source_ip IS NOT NULL
  UNION ALL SELECT event_id, t, 'IP', destination_ip, destination_ip, 'destination_ip' FROM kind WHERE destination_ip IS NOT NULL
  UNION ALL SELECT event_id, t, 'Process', process_key, process, 'process' FROM kind WHERE process IS NOT NULL
  UNION ALL SELECT event_id, t, 'File', file, file, 'file' FROM kind WHERE file IS NOT NULL),
direct AS (
  SELECT CASE action WHEN 'login' THEN 'LOGGED_INTO' ELSE 'AUTHENTICATED_TO' END AS relationship_type, 'User' AS src_type, lower("user") AS src_key, CASE WHEN destination_host IS NULL THEN src_kind ELSE far_kind END AS dst_type, coalesce(destination_host, source_host) AS dst_key, event_id, t, "timestamp" FROM kind WHERE action IN ('login', 'authenticate')
  UNION ALL SELECT 'EXECUTED', src_kind, source_host, 'Process', process_key, event_id, t, "timestamp" FROM kind WHERE action = 'execute'
  UNION ALL SELECT 'CONNECTED_TO', src_kind, source_host, far_kind, far, event_id, t, "timestamp" FROM kind WHERE action = 'connect'
  UNION ALL SELECT 'ACCESSED', src_kind, source_host, 'File', file, event_id, t, "timestamp" FROM kind WHERE action = 'access'),
derived AS (SELECT * FROM (SELECT c.event_id, c.t, c."timestamp", c.far, c.far_kind, e.event_id AS exec_id, e.process_key, row_number() OVER (PARTITION BY c.event_id ORDER BY e.t DESC, e.event_id DESC) AS n
  FROM kind c JOIN kind e ON e.source_host = c.source_host AND e.action = 'execute' AND e.t <= c.t AND e.t >= c.t - INTERVAL 10 MINUTE WHERE c.action = 'connect') WHERE n = 1),
edge AS (SELECT *, FALSE AS derived, [event_id] AS event_ids FROM direct
  UNION ALL SELECT 'CONNECTED_TO', 'Process', process_key, far_kind, far, event_id, t, "timestamp", TRUE, [exec_id, event_id] FROM derived),
ckey AS (SELECT DISTINCT event_id, t, kind, value FROM (
  SELECT event_id, t, 'user' AS kind, lower("user") AS value FROM kind UNION ALL SELECT event_id, t, 'host', source_host FROM kind UNION ALL SELECT event_id, t, 'host', destination_host FROM kind
  UNION ALL SELECT event_id, t, 'ip', source_ip FROM kind UNION ALL SELECT event_id, t, 'ip', destination_ip FROM kind UNION ALL SELECT event_id, t, 'file', file FROM kind UNION ALL SELECT event_id, t, 'process', process_key FROM kind) WHERE value IS NOT NULL),
bkey AS (SELECT *, epoch_us(t) // 600000000 AS bucket FROM ckey),
cand AS (SELECT a.event_id AS event_a, b.event_id AS event_b, string_agg(DISTINCT a.kind, ',' ORDER BY a.kind) AS kinds
  FROM (SELECT *, bucket AS at FROM bkey UNION ALL SELECT *, bucket + 1 FROM bkey) a JOIN bkey b ON a.kind = b.kind AND a.value = b.value AND a.at = b.bucket
  AND (a.t < b.t OR a.t = b.t AND a.event_id < b.event_id) AND b.t - a.t <= INTERVAL 10 MINUTE GROUP BY 1, 2),
cor AS (SELECT event_a, event_b, list_sort(list_filter([
    CASE WHEN lower(x."user") = lower(y."user") THEN 'shared_user' END,
    CASE WHEN x.source_host = y.source_host OR x.destination_host = y.destination_host THEN 'shared_host' END,
    CASE WHEN x.source_ip IN (y.source_ip, y.destination_ip) OR x.destination_ip IN (y.source_ip, y.destination_ip) THEN 'shared_ip' END,
    CASE WHEN x.destination_host = y.source_host THEN 'host_continuity' END,
    CASE WHEN x.process_key = y.process_key THEN 'shared_process' END,
    CASE WHEN x.file = y.file THEN 'shared_file' END,
    CASE WHEN y.t - x.t <= INTERVAL 10 MINUTE THEN 'temporal_proximity' END,
    CASE WHEN x.action || '>' || y.action IN ('login>execute', 'authenticate>execute', 'execute>connect', 'connect>access') THEN 'compatible_sequence' END], lambda s: s IS NOT NULL)) AS signals,
  (epoch_us(y.t) - epoch_us(x.t)) // 1000000 AS gap_seconds, x.action AS action_a
  FROM cand JOIN kind x ON x.event_id = event_a JOIN kind y ON y.event_id = event_b),
corr AS (SELECT *, list_contains(signals, 'temporal_proximity') AND len(list_filter(signals, lambda s: s NOT IN ('temporal_proximity', 'compatible_sequence'))) > 0 AS related FROM cor)
"""


def _sim(sql: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{SE}{sql}"


#: Two investigations by the number of an edge's event.
TWO = """, edge2 AS (SELECT *, CASE WHEN CAST(substr(event_id, 5) AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS inv FROM edge)"""
UND2 = (
    TWO
    + """, und2 AS (SELECT inv, relationship_type, event_id, event_ids, t, src_type AS node_type, src_key AS node, dst_type AS neighbour_type, dst_key AS neighbour, TRUE AS forward FROM edge2
  UNION ALL SELECT inv, relationship_type, event_id, event_ids, t, dst_type, dst_key, src_type, src_key, FALSE FROM edge2)"""
)


def _walk(depth: int, where: str = "TRUE") -> str:
    """Nodes with their least hop from user1 in each investigation, and the observations that reach them there."""
    return f"""{UND2}, used AS (SELECT * FROM und2 WHERE {where}), near AS (SELECT DISTINCT inv, node_type, node, neighbour_type, neighbour FROM used),
      steps AS (SELECT DISTINCT inv, node_type, node, 0 AS hop FROM used WHERE node = 'user1' AND node_type = 'User'
        UNION SELECT near.inv, near.neighbour_type, near.neighbour, hop + 1 FROM steps JOIN near ON near.inv = steps.inv AND near.node_type = steps.node_type AND near.node = steps.node WHERE hop < {depth}),
      least AS (SELECT inv, node_type, node, min(hop) AS hop FROM steps GROUP BY ALL),
      led AS (SELECT u.*, y.hop FROM used u JOIN least x ON x.inv = u.inv AND x.node_type = u.node_type AND x.node = u.node JOIN least y ON y.inv = u.inv AND y.node_type = u.neighbour_type AND y.node = u.neighbour AND y.hop = x.hop + 1),
      reached AS (SELECT inv, neighbour_type, neighbour, hop, list_sort(list_distinct(flatten(list(event_ids)))) AS ids FROM led GROUP BY ALL)"""


def _arrivals(depth: int) -> str:
    """The earliest arrival at each node from user1 in exactly so many hops, each no earlier than the one before; dominated labels don't go on."""
    pick = "row_number() OVER (PARTITION BY inv, tt, n ORDER BY t, event_ids, relationship_type, ft, f) AS place"
    first = "SELECT inv, tt, n, t, t AS leaves, ft || ':' || f || ' > ' || tt || ':' || n AS nodes, relationship_type AS kinds, array_to_string(event_ids, '+') AS evidence, event_ids, relationship_type, ft, f FROM link WHERE f = 'user1' AND ft = 'User' AND (n <> 'user1' OR tt <> 'User')"
    parts = [f"c1 AS ({first}), l1 AS (SELECT *, 1 AS hops FROM (SELECT *, {pick} FROM c1) WHERE place = 1)"]
    for h in range(2, depth + 1):
        known = " UNION ALL ".join(f"SELECT inv, tt, n, t FROM l{k}" for k in range(1, h))
        parts.append(f"""k{h} AS (SELECT inv, tt, n, min(t) AS known FROM ({known}) GROUP BY ALL),
          c{h} AS (SELECT link.inv, link.tt, link.n, link.t, leaves, nodes || ' > ' || link.tt || ':' || link.n AS nodes, kinds || ' > ' || link.relationship_type AS kinds, evidence || ' > ' || array_to_string(link.event_ids, '+') AS evidence, link.event_ids, link.relationship_type, link.ft, link.f
            FROM l{h - 1} p JOIN link ON link.inv = p.inv AND link.ft = p.tt AND link.f = p.n AND link.t >= p.t WHERE (link.n <> 'user1' OR link.tt <> 'User') AND (p.n <> 'FIN-SRV-02' OR p.tt <> 'Server')),
          l{h} AS (SELECT r.*, {h} AS hops FROM (SELECT *, {pick} FROM c{h}) r LEFT JOIN k{h} ON k{h}.inv = r.inv AND k{h}.tt = r.tt AND k{h}.n = r.n WHERE place = 1 AND (known IS NULL OR r.t < known))""")
    columns = "inv, tt, n, t, leaves, nodes, kinds, evidence, hops"
    return ", ".join(parts) + ", reached AS (" + " UNION ALL ".join(f"SELECT {columns} FROM l{k}" for k in range(1, depth + 1)) + ")"


def _matches(kind: str, steps: list[tuple[str, str, int, str | None]], most: int | None = None) -> str:
    """Matches by looking up, from the first step on, the next event that satisfies each step: (name, condition, seconds, exclusion)."""
    parts = [f", ev AS (SELECT DISTINCT c.value AS key, c.t, c.event_id, k.action, k.destination_host FROM ckey c JOIN kind k USING (event_id) WHERE c.kind = '{kind}'), s0 AS (SELECT key, t AS began, t, event_id, event_id AS ids FROM ev WHERE {steps[0][1]})"]
    for k, (_, when, within, unless) in enumerate(steps[1:], 1):
        broken = f"AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.key = p.key AND ({unless}) AND (b.t > p.t OR b.t = p.t AND b.event_id > p.event_id) AND (b.t < n.t OR b.t = n.t AND b.event_id < n.event_id))" if unless else ""
        parts.append(f"""n{k} AS (SELECT p.key, p.event_id, arg_min({{'t': e.t, 'id': e.event_id}}, (e.t, e.event_id)) AS nxt FROM (SELECT DISTINCT key, t, event_id FROM s{k - 1}) p JOIN (SELECT * FROM ev WHERE {when}) e ON e.key = p.key AND (e.t > p.t OR e.t = p.t AND e.event_id > p.event_id) GROUP BY ALL),
          s{k} AS (SELECT p.key, p.began, n.t, n.event_id, p.ids || ' > ' || n.event_id AS ids FROM s{k - 1} p JOIN (SELECT key, event_id AS before, nxt.t AS t, nxt.id AS event_id FROM n{k}) n ON n.key = p.key AND n.before = p.event_id WHERE n.t - p.t <= INTERVAL {within} SECOND {broken})""")
    last = len(steps) - 1
    names = " > ".join(s[0] for s in steps)
    return _sim(", ".join(parts) + f" SELECT key AS entity_key, strftime(began, {STAMP}) AS first_seen, strftime(t, {STAMP}) AS last_seen, '{names}' AS steps, ids AS event_ids FROM s{last}" + (f" WHERE t - began <= INTERVAL {most} SECOND" if most else ""))


def _pivot(start: str, end: str, test: str, end_type: str) -> str:
    return _sim(f"{TWO} SELECT inv AS investigation_id, {start} AS start_key, {end_type} AS end_type, {end} AS end_key, count(*) AS n, strftime(min(t), {STAMP}) AS first_seen, strftime(max(t), {STAMP}) AS last_seen FROM edge2 WHERE {test} GROUP BY ALL")


LOGINS = "relationship_type IN ('LOGGED_INTO', 'AUTHENTICATED_TO') AND src_type = 'User'"
PIVOTS = {
    "piv_09_host_users": _pivot("dst_key", "src_key", f"{LOGINS} AND dst_type = 'Host'", "src_type"),
    "piv_10_host_processes": _pivot("src_key", "dst_key", "relationship_type = 'EXECUTED' AND src_type = 'Host' AND dst_type = 'Process'", "dst_type"),
    "piv_11_host_destinations": _pivot("src_key", "dst_key", "relationship_type = 'CONNECTED_TO' AND src_type = 'Host'", "dst_type"),
    "piv_12_server_users": _pivot("dst_key", "src_key", f"{LOGINS} AND dst_type = 'Server'", "src_type"),
    "piv_13_user_hosts": _pivot("src_key", "dst_key", LOGINS, "dst_type"),
    "piv_14_process_destinations": _pivot("src_key", "dst_key", "relationship_type = 'CONNECTED_TO' AND src_type = 'Process'", "dst_type"),
    "piv_15_server_files": _pivot("src_key", "dst_key", "relationship_type = 'ACCESSED' AND src_type = 'Server' AND dst_type = 'File'", "dst_type"),
}
CASES_SQL = """c AS (SELECT 'case-' || n_nationkey AS investigation_id, n_nationkey AS k, CASE WHEN n_nationkey % 8 = 0 THEN lower(n_name) ELSE n_name END AS title, 'region ' || n_regionkey AS description,
  CASE WHEN n_nationkey % 8 = 0 THEN 'OPEN' WHEN n_nationkey % 4 = 0 THEN 'CLOSED' WHEN n_nationkey % 2 = 0 THEN 'UNDER_REVIEW' ELSE 'OPEN' END AS status,
  CASE WHEN n_nationkey % 8 = 0 THEN 'ESCALATE' WHEN n_nationkey % 4 = 0 THEN 'CLOSE_AS_INVESTIGATED' END AS outcome FROM nation)"""
#: What is wrong with each damaged event.
DAMAGED = """, n AS (SELECT *, CAST(substr(event_id, 5) AS BIGINT) AS number FROM kind), dam AS (SELECT *, CASE WHEN number % 50 = 49 THEN 'event is not a JSON object' ELSE CASE number % 9 WHEN 0 THEN 'event_id is required' WHEN 1 THEN 'event_type is required' WHEN 2 THEN 'action is required'
  WHEN 3 THEN 'timestamp is required' WHEN 4 THEN 'timestamp is malformed' WHEN 5 THEN 'severity must be a scalar' WHEN 6 THEN 'severity must be a scalar' END END AS message FROM n),
  bad AS (SELECT event_id AS record, CASE WHEN number % 50 = 49 THEN 'PARSE_ERROR' ELSE 'VALIDATION_ERROR' END AS error, message FROM dam WHERE message IS NOT NULL)"""
SAID = """, st AS (SELECT event_id AS statement_id, CAST(substr(event_id, 5) AS BIGINT) % 6 AS r FROM se),
  g AS (SELECT statement_id, r, CASE WHEN r = 1 THEN 0 ELSE 1 END::BIGINT AS n_named, CASE WHEN r IN (0, 1) THEN 0 ELSE 1 END::BIGINT AS n_known, CASE WHEN r IN (2, 3) THEN 3 ELSE 2 END::BIGINT AS n_entities_named, 2::BIGINT AS n_entities_known,
    CASE WHEN r IN (0, 2, 3) THEN 'invented' WHEN r = 1 THEN 'unsupported' ELSE 'grounded' END AS verdict FROM st)"""


UND = """, und AS (SELECT relationship_type, event_id, t, "timestamp", src_key AS node, dst_key AS neighbour, dst_type AS neighbour_type, TRUE AS forward FROM edge
  UNION ALL SELECT relationship_type, event_id, t, "timestamp", dst_key, src_key, src_type, FALSE FROM edge)"""
REFS = """, refs AS (SELECT event_id, string_agg(DISTINCT ref, '; ' ORDER BY ref) AS relationship_refs FROM (SELECT unnest(event_ids) AS event_id, src_key || ' -' || relationship_type || '-> ' || dst_key AS ref FROM edge) GROUP BY 1)"""


def oracle_sql() -> dict[str, str]:
    out = {
        "src_05_security_events": _sim('SELECT event_id, "timestamp", event_type, action, "user", source_host, destination_host, source_ip, destination_ip, process, file, severity FROM se'),
        "nrm_09_field_mapping": _sim("""SELECT action, array_to_string(list_sort(list_filter(['action', 'event_id', 'event_type', 'source_host', 'timestamp', 'user', CASE WHEN destination_host IS NOT NULL THEN 'destination_host' END,
            CASE WHEN source_ip IS NOT NULL THEN 'source_ip' END, CASE WHEN destination_ip IS NOT NULL THEN 'destination_ip' END, CASE WHEN process IS NOT NULL THEN 'process' END, CASE WHEN file IS NOT NULL THEN 'file' END], lambda x: x IS NOT NULL)), ',') AS mapped_fields, count(*) AS n FROM se GROUP BY 1, 2"""),
        "par_06_tristate": _sim("SELECT event_id, 'internal' AS format, ['VALUE', 'EMPTY', 'NULL', 'MISSING'][CAST(substr(event_id, 5) AS BIGINT) % 4 + 1] AS user_state, CASE WHEN file IS NULL THEN 'MISSING' ELSE 'VALUE' END AS file_state FROM se"),
        "par_03_primitives": _sim(""", n AS (SELECT CAST(substr(event_id, 5) AS BIGINT) AS n FROM se), mem(name, kind) AS (VALUES ('count', 'BIGINT'), ('digits', 'STRING'), ('ratio', 'NUMBER'), ('ok', 'BOOLEAN'), ('nothing', 'VOID'), ('seen', 'TIMESTAMP'), ('list', 'ARRAY'))
            SELECT name, kind, count(*) AS n, (sum(CASE WHEN name = 'count' THEN n END))::BIGINT AS whole, sum(CASE WHEN name = 'ratio' THEN n % 8 / 8 + 0.5 END)::DOUBLE AS number, count(*) FILTER (name = 'ok' AND n % 2 = 0) AS flags, (sum(CASE WHEN name = 'seen' THEN n % 6 - 3600 END))::BIGINT AS moment,
            max(CASE name WHEN 'digits' THEN n::VARCHAR WHEN 'list' THEN '[1,2]' END) AS text FROM n, mem GROUP BY ALL"""),
        "val_06_rejects": _sim("""SELECT event_id, event_id || CASE WHEN CAST(substr(event_id, 5) AS BIGINT) % 13 = 0 THEN '' ELSE '+' END AS record, 'VALIDATION_ERROR' AS error, CASE WHEN CAST(substr(event_id, 5) AS BIGINT) % 13 = 0 THEN 'timestamp is malformed' ELSE 'event_id occurs already' END AS message, 400::BIGINT AS status
            FROM se WHERE CAST(substr(event_id, 5) AS BIGINT) % 13 = 0 OR CAST(substr(event_id, 5) AS BIGINT) % 11 = 0"""),
        "val_13_one_delivery": _sim("SELECT event_id, event_id || CASE WHEN CAST(substr(event_id, 5) AS BIGINT) % 13 = 0 THEN '+' ELSE '' END AS record FROM se"),
        "ent_07_occurrences": _sim("SELECT event_id, entity_type, entity_key, name, role FROM occ"),
        "ent_10_entities": _sim(f"SELECT entity_type, entity_key, strftime(min(t), {STAMP}) AS first_seen, strftime(max(t), {STAMP}) AS last_seen, count(DISTINCT event_id) AS n_events, md5(string_agg(DISTINCT event_id, ',' ORDER BY event_id)) AS event_ids_md5 FROM occ GROUP BY 1, 2"),
        "rel_08_observations": _sim("""SELECT relationship_type, src_type, src_key, dst_type, dst_key, event_id, "timestamp", 'events' AS source FROM direct"""),
        "rel_04_host_to_host": _sim("""SELECT CASE WHEN source_host = 'ENG-PC-07' THEN 'Server' ELSE src_kind END AS src_type, source_host AS src_key, CASE WHEN destination_host IN ('FIN-SRV-01', 'FIN-SRV-03') THEN 'Host' ELSE far_kind END AS dst_type, far AS dst_key, event_id FROM kind WHERE action = 'connect'"""),
        "rel_13_no_edge": _sim("""SELECT event_id, CASE WHEN CAST(substr(event_id, 5) AS BIGINT) % 6 = 0 THEN 'observe' ELSE action END AS action FROM kind
            WHERE CAST(substr(event_id, 5) AS BIGINT) % 6 = 0 OR CAST(substr(event_id, 5) AS BIGINT) % 6 = 1 AND action IN ('login', 'authenticate') OR CAST(substr(event_id, 5) AS BIGINT) % 6 = 2 AND (action IN ('execute', 'connect', 'access') OR destination_host IS NULL)"""),
        "rel_10_relationships": _sim(f"SELECT relationship_type, src_key, dst_key, strftime(min(t), {STAMP}) AS first_seen, strftime(max(t), {STAMP}) AS last_seen, count(*) AS n, string_agg(DISTINCT event_id, ',' ORDER BY event_id) AS event_ids FROM direct GROUP BY relationship_type, src_type, src_key, dst_type, dst_key"),
        "rel_11_derived_edges": _sim("SELECT process_key, far AS dst_key, exec_id AS exec_event_id, event_id AS connect_event_id FROM derived"),
        "cnd_07_candidates": _sim("SELECT event_a, event_b, kinds FROM cand"),
        "cnd_09_incremental": _sim("SELECT event_a, event_b, kinds FROM cand JOIN kind x ON x.event_id = event_a JOIN kind y ON y.event_id = event_b WHERE x.t >= TIMESTAMP '2024-01-25' OR y.t >= TIMESTAMP '2024-01-25'"),
        "cor_09_correlations": _sim("SELECT event_a, event_b, array_to_string(signals, ',') AS signals, gap_seconds, related FROM corr"),
        "cor_13_reasons": _sim("SELECT CASE WHEN gap_seconds < 60 THEN 'within a minute' ELSE (gap_seconds // 60) || ' minutes' END || ' after ' || action_a AS reason, count(*) AS n FROM corr GROUP BY 1"),
        "cor_14_sequences": _sim(
            """, pair AS (SELECT event_a AS u, event_b AS v FROM corr WHERE related UNION SELECT event_b, event_a FROM corr WHERE related),
            walk AS (SELECT DISTINCT u AS node, u AS low FROM pair UNION SELECT pair.v, walk.low FROM walk JOIN pair ON pair.u = walk.node WHERE walk.low < pair.v)
            SELECT min(low) AS sequence_id, node AS event_id FROM walk GROUP BY node""",
            True,
        ),
        "grf_04_graph_filtered": _sim("""SELECT relationship_type, src_key, dst_key, event_id, "timestamp" FROM edge WHERE t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND relationship_type IN ('CONNECTED_TO', 'ACCESSED') ORDER BY t, relationship_type, src_key, dst_key, event_id LIMIT 500"""),
        "grf_11_graph_counts": _sim(TWO + " SELECT inv AS investigation_id, relationship_type, count(DISTINCT src_type || chr(1) || src_key || chr(1) || dst_type || chr(1) || dst_key) AS n_edges, count(DISTINCT event_id) AS n_events FROM edge2 GROUP BY ALL"),
        "piv_01_neighbours": _sim(UND + """ SELECT relationship_type, neighbour, event_id, "timestamp", forward FROM und WHERE node = 'FIN-SRV-02'"""),
        "piv_02_around_anchor": _sim(UND + """ SELECT relationship_type, neighbour, event_id, "timestamp" FROM und WHERE node = 'FIN-SRV-02' AND t BETWEEN TIMESTAMP '2024-01-09 12:00:00' AND TIMESTAMP '2024-01-11 12:00:00'"""),
        "piv_03_bfs": _sim(_walk(3) + " SELECT inv AS investigation_id, neighbour AS node, neighbour_type AS node_type, hop::BIGINT AS hop, len(ids) AS n_events, md5(array_to_string(ids, ',')) AS event_ids_md5 FROM reached", True),
        "piv_04_filtered": _sim(
            _walk(2, "inv = 'odd' AND t BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20' AND relationship_type IN ('LOGGED_INTO', 'EXECUTED')")
            + " SELECT inv AS investigation_id, neighbour AS node, neighbour_type AS node_type, hop::BIGINT AS hop, array_to_string(ids, ',') AS event_ids FROM reached WHERE neighbour_type IN ('Host', 'Server', 'Process') ORDER BY hop, inv, neighbour_type, neighbour LIMIT 500",
            True,
        ),
        "piv_07_hop_evidence": _sim(_walk(2) + " SELECT inv AS investigation_id, hop::BIGINT AS hop, relationship_type, node, neighbour, event_id, forward, array_to_string(event_ids, '+') AS evidence FROM led", True),
        "piv_08_paths": _sim(
            TWO
            + """, link AS (SELECT inv, src_type || ':' || src_key AS a, dst_type || ':' || dst_key AS b, dst_key, relationship_type, array_to_string(list_sort(list_distinct(flatten(list(event_ids)))), '+') AS ids FROM edge2
              WHERE t <= TIMESTAMP '2024-01-12' AND relationship_type IN ('LOGGED_INTO', 'EXECUTED', 'CONNECTED_TO', 'ACCESSED') GROUP BY ALL),
            p AS (SELECT DISTINCT inv, a AS last, [a] AS seen, ['user1'] AS nodes, [] :: VARCHAR[] AS kinds, [] :: VARCHAR[] AS evidence FROM link WHERE a = 'User:user1'
              UNION ALL SELECT p.inv, b, list_append(seen, b), list_append(nodes, dst_key), list_append(kinds, relationship_type), list_append(evidence, ids) FROM p JOIN link ON link.inv = p.inv AND a = last WHERE NOT list_contains(seen, b) AND len(kinds) < 4)
            SELECT inv AS investigation_id, array_to_string(nodes, ' > ') AS path, array_to_string(kinds, ' > ') AS relationships, len(kinds)::BIGINT AS hops, md5(array_to_string(evidence, ' > ')) AS evidence_md5 FROM p WHERE len(kinds) > 0""",
            True,
        ),
        "piv_17_long_paths": _sim(
            UND2
            + ", link AS (SELECT inv, t, event_ids, relationship_type, node_type AS ft, node AS f, neighbour_type AS tt, neighbour AS n FROM und2 WHERE t >= TIMESTAMP '2024-01-02'), "
            + _arrivals(10)
            + f" SELECT inv AS investigation_id, hops::BIGINT AS hops, strftime(leaves, {STAMP}) AS leaves, strftime(t, {STAMP}) AS arrives, nodes AS route, kinds AS relationships, evidence FROM reached WHERE tt = 'Server' AND n = 'FIN-SRV-02'"
        ),
        "tml_01_timeline": _sim(REFS + """ SELECT "timestamp", event_id, event_type, action, "user", source_host, destination_host, process, file, 'events' AS source, 'event' AS kind, coalesce(relationship_refs, '') AS relationship_refs FROM se LEFT JOIN refs USING (event_id)"""),
        "tml_04_entity_timeline": _sim("""SELECT "timestamp", event_id, action, "user" FROM se WHERE action IN ('connect', 'access') AND t BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' AND event_id IN (SELECT event_id FROM occ WHERE entity_key = 'FIN-SRV-02')"""),
        "tml_08_marked": _sim("SELECT 'event' AS kind, count(*) AS n FROM se UNION ALL SELECT 'derived', count(*) FROM derived"),
        "tml_09_sessions": _sim(
            f""", g AS (SELECT lower("user") AS user_key, t, CASE WHEN t < lag(t) OVER (PARTITION BY lower("user") ORDER BY t) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM se),
            s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_key ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g)
            SELECT user_key, strftime(min(t), {STAMP}) AS first_seen, strftime(max(t), {STAMP}) AS last_seen, count(*) AS n FROM s GROUP BY user_key, s"""
        ),
        "tml_10_adjacent": _sim("""SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM se WINDOW w AS (PARTITION BY "user" ORDER BY t, event_id)"""),
        "evd_02_edge_evidence": _sim(", each AS (SELECT relationship_type, src_key, dst_key, derived, unnest(event_ids) AS event_id FROM edge) SELECT relationship_type, src_key, dst_key, derived, event_id, action FROM each JOIN se USING (event_id)"),
        "evd_04_event_edges": _sim(", each AS (SELECT derived, unnest(event_ids) AS event_id FROM edge) SELECT event_id, count(*) AS n_edges, count(*) FILTER (derived) AS n_derived FROM each GROUP BY 1"),
        "evd_06_untraceable_edges": _sim(", each AS (SELECT unnest(event_ids) AS event_id FROM edge) SELECT count(*) AS n FROM each WHERE event_id NOT IN (SELECT event_id FROM se)"),
        "obs_01_pipeline_counts": _sim(
            """SELECT 'input' AS metric, count(*) AS n FROM events UNION ALL SELECT 'valid', count(*) FROM se UNION ALL SELECT 'rejected', 0 UNION ALL SELECT 'entities', count(*) FROM (SELECT DISTINCT entity_type, entity_key FROM occ)
            UNION ALL SELECT 'relationships', count(*) FROM (SELECT DISTINCT relationship_type, src_type, src_key, dst_type, dst_key FROM edge) UNION ALL SELECT 'correlated_links', count(*) FROM corr WHERE related"""
        ),
        "src_09_mixed_sources": _sim("""SELECT event_id, "timestamp", action, "user", process, file, ['SIEM', 'EDR', 'dataset', 'Sysmon'][CAST(substr(event_id, 5) AS BIGINT) % 4 + 1] AS source_type,
            ['lines', 'arrays', 'table', 'single'][CAST(substr(event_id, 5) AS BIGINT) % 4 + 1] AS source_name, event_id AS raw_event_id FROM se"""),
        "src_11_list_events": _sim("""SELECT event_id, "timestamp", action, CASE WHEN action = 'login' THEN 0 ELSE 1 END AS added_later FROM se WHERE "user" LIKE '%7'"""),
        "snk_01_graph_tables": _sim(TWO + """, named AS (SELECT *, CASE inv WHEN 'even' THEN '007' ELSE 'case:1' END AS investigation_id FROM edge2), node AS (SELECT DISTINCT CASE WHEN CAST(substr(event_id, 5) AS BIGINT) % 2 = 0 THEN '007' ELSE 'case:1' END AS investigation_id, entity_type, entity_key, event_id FROM occ)
            SELECT investigation_id, relationship_type AS kind, src_type, dst_type, derived, count(*) AS n, count(DISTINCT event_id) AS n_events, min(array_to_string(event_ids, '+')) AS least FROM named GROUP BY ALL
            UNION ALL SELECT investigation_id, entity_type, NULL, NULL, NULL, count(DISTINCT entity_key), count(*), min(entity_key) FROM node GROUP BY investigation_id, entity_type"""),
        "snk_05_retained": _sim("SELECT event_id, t >= TIMESTAMP '2024-01-15 12:00:00' AS covered FROM se WHERE t >= TIMESTAMP '2024-01-15'"),
        "nrm_02_vendor_fields": _sim("""SELECT event_id, "timestamp", action, CASE CAST(substr(event_id, 5) AS BIGINT) % 3 WHEN 0 THEN 'CORP' WHEN 1 THEN 'corp.example' END AS user_domain, lower("user") AS user_key, source_host AS source_host_key, process_key, 'D:/data/' || file AS file_key,
            source_ip, CASE WHEN destination_ip IS NOT NULL THEN '2001:db8::' || CASE WHEN destination_ip LIKE '%.0' THEN '' ELSE string_split(destination_ip, '.')[4] END END AS destination_ip, CASE WHEN CAST(substr(event_id, 5) AS BIGINT) % 2 = 0 THEN 5 ELSE -1 END AS severity_level, 'Vendor' AS unknown FROM kind"""),
        "val_01_damaged_events": _sim(DAMAGED + " SELECT record, error, message FROM bad"),
        "val_10_no_partial_graph": _sim(DAMAGED + " SELECT event_id, relationship_type, src_key, dst_key FROM direct WHERE event_id NOT IN (SELECT record FROM bad)"),
        "err_01_envelopes": _sim(DAMAGED + " SELECT '400' AS status, error, message, count(*) AS n FROM bad GROUP BY ALL"),
        "ent_03_roles": _sim("""SELECT CASE WHEN entity_key = 'FIN-SRV-01' OR entity_key LIKE '%SRV%3' THEN 'Host' WHEN entity_key LIKE '%3' OR entity_key LIKE '%SRV%' THEN 'Server' ELSE 'Host' END AS entity_type, entity_key, role, count(*) AS n FROM occ WHERE role IN ('source_host', 'destination_host') GROUP BY ALL"""),
        "cor_11_strength": _sim(""", w AS (SELECT c.event_a, c.event_b, list_filter(c.signals, lambda s: s <> 'compatible_sequence') AS s, x.action || '>' || y.action = 'login>connect' AS q FROM cor c JOIN kind x ON x.event_id = event_a JOIN kind y ON y.event_id = event_b WHERE y.t - x.t <= INTERVAL 5 MINUTE)
            SELECT event_a, event_b, CASE WHEN list_contains(s, 'shared_user') THEN 2.0 ELSE 0 END + CASE WHEN list_contains(s, 'shared_host') THEN 1.0 ELSE 0 END + CASE WHEN list_contains(s, 'shared_ip') THEN 0.5 ELSE 0 END + CASE WHEN q THEN 0.25 ELSE 0 END::DOUBLE AS strength, len(s)::BIGINT + CASE WHEN q THEN 1 ELSE 0 END AS signal_count FROM w"""),
        "grf_02_merged_entities": _sim(f"SELECT entity_type, entity_key, arg_min(name, (t, event_id)) AS name, strftime(min(t), {STAMP}) AS first_seen, strftime(max(t), {STAMP}) AS last_seen, count(DISTINCT event_id) AS n_events, md5(string_agg(DISTINCT event_id, ',' ORDER BY event_id)) AS event_ids_md5 FROM occ GROUP BY 1, 2"),
        "grf_09_entity_detail": _sim(""", ends AS (SELECT src_type AS a, src_key AS node, dst_type || chr(1) || dst_key AS b, relationship_type FROM edge UNION ALL SELECT dst_type, dst_key, src_type || chr(1) || src_key, relationship_type FROM edge),
            o AS (SELECT node, string_agg(relationship_type || '=' || n, ',' ORDER BY relationship_type) AS observations FROM (SELECT node, relationship_type, count(*) AS n FROM ends WHERE a = 'Server' GROUP BY ALL) GROUP BY 1)
            SELECT entity_key, count(DISTINCT event_id) AS n_events, (SELECT count(DISTINCT b) FROM ends WHERE node = entity_key AND a = 'Server') AS n_neighbours, any_value(o.observations) AS observations FROM occ LEFT JOIN o ON o.node = entity_key WHERE entity_type = 'Server' GROUP BY entity_key"""),
        "tml_05_event_types": _sim(REFS.replace("string_agg(DISTINCT ref, '; ' ORDER BY ref)", "count(DISTINCT ref)") + " SELECT event_id, event_type, coalesce(relationship_refs, 0)::BIGINT AS n_refs FROM se LEFT JOIN refs USING (event_id) WHERE event_type IN ('network', 'file')"),
        "evd_01_details": _sim(""", o AS (SELECT event_id, count(DISTINCT (entity_type, entity_key, role)) AS n FROM occ GROUP BY 1), each AS (SELECT unnest(event_ids) AS event_id, relationship_type, src_key, dst_key, derived FROM edge),
            r AS (SELECT event_id, count(DISTINCT (relationship_type, src_key, dst_key, derived)) AS n FROM each GROUP BY 1), p AS (SELECT event_id, count(*) AS n FROM (SELECT event_a AS event_id FROM corr WHERE related UNION ALL SELECT event_b FROM corr WHERE related) GROUP BY 1)
            SELECT se.event_id, coalesce(o.n, 0)::BIGINT AS n_entities, coalesce(r.n, 0)::BIGINT AS n_relationships, coalesce(p.n, 0)::BIGINT AS n_correlations FROM se LEFT JOIN o USING (event_id) LEFT JOIN r USING (event_id) LEFT JOIN p USING (event_id)"""),
        "evd_05_untraceable": _sim(", each AS (SELECT unnest(event_ids) AS event_id, relationship_type, src_key, dst_key FROM edge) SELECT event_id, relationship_type, src_key, dst_key FROM each WHERE event_id IN (SELECT event_id FROM se WHERE CAST(substr(event_id, 5) AS BIGINT) % 17 = 0)"),
        "inv_02_cases": f"""WITH {CASES_SQL} SELECT investigation_id, title, description, status, outcome, '2024-02-01 00:00:00.000000' AS created_at, CASE WHEN k % 8 = 0 THEN '2024-02-03 00:00:00.000000' WHEN k % 2 = 0 THEN '2024-02-02 00:00:00.000000' ELSE '2024-02-01 00:00:00.000000' END AS updated_at,
            CASE WHEN k % 4 = 0 AND k % 8 <> 0 THEN '2024-02-02 00:00:00.000000' END AS closed_at FROM c""",
        "inv_07_notes": "SELECT 'case-' || c_nationkey AS investigation_id, c_mktsegment AS author, 'analyst' AS kind, count(*) AS n, max('about ' || c_name) AS last_note FROM customer GROUP BY ALL",
        "sec_01_visible": f"WITH {CASES_SQL} SELECT investigation_id, title FROM c WHERE description = 'region 2'",
        "aix_01_context": _sim(
            """, link AS (SELECT src_type || ':' || src_key AS a, dst_type || ':' || dst_key AS b, dst_key, relationship_type, list_sort(list_distinct(flatten(list(event_ids))))[1:20] AS ids FROM edge WHERE t <= TIMESTAMP '2024-01-12' GROUP BY ALL),
            p AS (SELECT 'user1 > ' || dst_key AS path, 1 AS hops, [ids] AS evidence FROM link WHERE a = 'User:user1' UNION ALL SELECT 'user1 > ' || x.dst_key || ' > ' || y.dst_key, 2, [x.ids, y.ids] FROM link x JOIN link y ON y.a = x.b WHERE x.a = 'User:user1' AND y.b <> 'User:user1'),
            ranked AS (SELECT 'timeline' AS part, event_id AS item, row_number() OVER (ORDER BY t, event_id) AS n FROM se
              UNION ALL SELECT 'entities', entity_key, row_number() OVER (ORDER BY entity_type, entity_key) FROM (SELECT DISTINCT entity_type, entity_key FROM occ)
              UNION ALL SELECT 'relationships', dst_key, row_number() OVER (ORDER BY relationship_type, src_key, dst_key) FROM (SELECT DISTINCT relationship_type, src_type, src_key, dst_type, dst_key FROM edge)
              UNION ALL SELECT 'correlations', event_a, row_number() OVER (ORDER BY event_a, event_b) FROM corr WHERE related
              UNION ALL SELECT 'paths', path, row_number() OVER (ORDER BY hops, path, evidence) FROM p)
            SELECT part, count(*) AS n, arg_min(item, n) AS first_item, arg_max(item, n) AS last_item FROM ranked WHERE n <= 50 GROUP BY part"""
        ),
        "snk_04_summary_audit": """SELECT 'sim' AS investigation_id, kind, n, 'TemplateProvider' AS provider, 'available' AS status, TRUE AS names_events, TRUE AS has_prompt, 'simulated case' AS description FROM (SELECT 'event' AS kind, count(*) AS n FROM events UNION ALL SELECT 'narrative', 1)""",
        "aix_08_grounding": _sim(SAID + " SELECT statement_id, n_named, n_known, n_entities_named, n_entities_known, verdict FROM g"),
        "evl_03_grounding_tally": _sim(SAID + """ SELECT CASE verdict WHEN 'grounded' THEN 'supported' WHEN 'invented' THEN 'incorrect' ELSE verdict END AS measure, count(*) AS n FROM g GROUP BY 1
            UNION ALL SELECT 'missing evidence', count(*) FROM se WHERE action = 'connect' AND CAST(substr(event_id, 5) AS BIGINT) % 6 IN (0, 1)"""),
        "evl_04_utility": _sim(""", h AS (SELECT DISTINCT event_id FROM derived), m AS (SELECT k.*, h.event_id IS NOT NULL AS hint, CASE WHEN t < lag(t) OVER (PARTITION BY "user" ORDER BY t) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM kind k LEFT JOIN h ON h.event_id = k.event_id),
            n AS (SELECT *, sum(fresh) OVER (PARTITION BY "user" ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM m),
            r AS (SELECT arg_min(event_type, (t, event_id)) AS scenario, bool_or(hint) AS assisted, (epoch_us(max(t)) - epoch_us(min(t))) / 1000000 AS seconds, count(DISTINCT source_host) AS pivots, count(DISTINCT event_type) AS sources_checked, count(*) AS events_inspected, bool_or(action = 'access') AS completed, count(destination_ip) AS errors FROM n GROUP BY "user", s)
            SELECT scenario, assisted, count(*) AS reviews, count(*) FILTER (completed) AS completed, round(avg(seconds) FILTER (completed), 4) AS mean_seconds, round(avg(pivots) FILTER (completed), 4) AS mean_pivots, round(avg(sources_checked) FILTER (completed), 4) AS mean_sources_checked,
            round(avg(events_inspected) FILTER (completed), 4) AS mean_events_inspected, round(avg(errors) FILTER (completed), 4) AS mean_errors FROM r GROUP BY scenario, assisted"""),
        "str_01_stream_ingest": _sim("""SELECT event_id, "timestamp", action, "user" FROM se UNION ALL SELECT 'evt-end', '2034-01-01 00:00:00.000000', 'end', 'nobody' UNION ALL SELECT 'evt-end2', '2034-01-01 00:00:00.000000', 'end', 'nobody' """),
        "str_03_stream_pairs": _sim("SELECT event_a, event_b, kinds FROM cand"),
        "str_06_late_rows": _sim("""SELECT 'evt-late-' || substr(event_id, 5) AS event_id, 'LATE_EVENT' AS error, 'event came after its time was closed' AS message FROM se WHERE CAST(substr(event_id, 5) AS BIGINT) % 5 = 0
            UNION ALL SELECT event_id, 'VALIDATION_ERROR', 'event_id occurs already' FROM se WHERE CAST(substr(event_id, 5) AS BIGINT) % 2 = 0 AND CAST(substr(event_id, 5) AS BIGINT) % 3 = 0"""),
        "snk_06_stream_entities": _sim(f"SELECT entity_type, entity_key, arg_min(name, (t, event_id, name)) AS name, strftime(min(t), {STAMP}) AS first_seen, strftime(max(t), {STAMP}) AS last_seen, count(DISTINCT event_id) AS n_events FROM occ GROUP BY 1, 2"),
        "snk_06_stream_relationships": _sim(f"SELECT relationship_type, src_type, src_key, dst_type, dst_key, strftime(min(t), {STAMP}) AS first_seen, strftime(max(t), {STAMP}) AS last_seen, count(*) AS n FROM direct GROUP BY ALL"),
        "src_04_line_source": _sim("""SELECT way, event_id, md5('{"event_id":"' || event_id || '","timestamp":"' || strftime(t, '%Y-%m-%dT%H:%M:%S.%fZ') || '","event_type":"' || event_type || '","action":"' || action || '","user":"' || "user" || '","source_host":"' || source_host || '"'
            || coalesce(',"destination_host":"' || destination_host || '"', '') || coalesce(',"source_ip":"' || source_ip || '"', '') || coalesce(',"destination_ip":"' || destination_ip || '"', '') || coalesce(',"process":"' || process || '"', '') || coalesce(',"file":"' || file || '"', '') || '}') AS raw_md5 FROM se, (VALUES ('table'), ('stream')) w(way)"""),
        "ent_10_evidence_segments": _sim(f""", each AS (SELECT DISTINCT entity_type, entity_key, event_id, t FROM occ UNION ALL SELECT 'Source', 'events', event_id, t FROM se)
            SELECT entity_type, entity_key, count(*) AS n_events, count(*) AS n_opened, sum(CAST(substr(event_id, 5) AS BIGINT))::BIGINT AS id_sum, strftime(min(t), {STAMP}) AS first_seen, strftime(max(t), {STAMP}) AS last_seen, TRUE AS bounded FROM each GROUP BY 1, 2"""),
        "ent_14_declared_entities": _sim("""SELECT 'Session' AS entity_type, source_host || '|' || lower('S-' || "user" || strftime(t, '-%m%d')) AS entity_key, 'session' AS role, count(*) AS n, min('S-' || "user" || strftime(t, '-%m%d')) AS name FROM se GROUP BY 2
            UNION ALL SELECT 'Service', 'SVC' || CAST(substr(event_id, 5) AS BIGINT) % 9, 'service', count(*), min('Svc' || CAST(substr(event_id, 5) AS BIGINT) % 9) FROM se WHERE CAST(substr(event_id, 5) AS BIGINT) % 4 = 0 GROUP BY 2"""),
        "ent_14_declared_edges": _sim(""", x AS (SELECT *, CAST(substr(event_id, 5) AS BIGINT) AS number, source_host || '|' || lower('S-' || "user" || strftime(t, '-%m%d')) AS session FROM kind)
            SELECT 'OPENED' AS relationship_type, 'User' AS src_type, lower("user") AS src_key, 'Session' AS dst_type, session AS dst_key, event_id FROM x WHERE action = 'login'
            UNION ALL SELECT 'RAN_IN', 'Process', process_key, 'Session', session, event_id FROM x WHERE process IS NOT NULL UNION ALL SELECT 'USED', 'Session', session, 'Service', 'SVC' || number % 9, event_id FROM x WHERE number % 4 = 0"""),
        "aix_08_mentions": _sim(""", x AS (SELECT event_id, CAST(substr(event_id, 5) AS BIGINT) AS n FROM se), y AS (SELECT event_id AS statement_id, CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS investigation_id, CASE WHEN n % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS n_event, 2::BIGINT AS n_entity, CASE WHEN n % 5 IN (1, 2, 3) THEN 1 ELSE 0 END::BIGINT AS n_unknown FROM x)
            SELECT *, CASE WHEN n_unknown > 0 THEN 'invented' WHEN n_event = 0 THEN 'unsupported' ELSE 'grounded' END AS verdict FROM y"""),
        "str_03_shared_keys": _sim(" SELECT x.event_id AS event_a, y.event_id AS event_b, x.kind, x.value FROM (SELECT *, bucket AS at FROM bkey UNION ALL SELECT *, bucket + 1 FROM bkey) x JOIN bkey y ON x.kind = y.kind AND x.value = y.value AND x.at = y.bucket AND (x.t < y.t OR x.t = y.t AND x.event_id < y.event_id) AND y.t - x.t <= INTERVAL 10 MINUTE"),
        "str_04_stream_windows": _sim(f"""SELECT CASE WHEN "user" LIKE '%7' THEN 'seven' ELSE 'rest' END AS investigation_id, strftime(date_trunc('hour', t), {STAMP}) AS window_start, action, count(*) AS n FROM se GROUP BY ALL"""),
        "str_07_stream_derived": _sim("SELECT process_key, far AS dst_key, exec_id AS exec_event_id, event_id AS connect_event_id FROM derived"),
        "evl_01_confusion": _sim(
            DAMAGED
            + """, w AS (SELECT d.*, 'week ' || (date_diff('day', DATE '2024-01-01', d.t::DATE) // 7) AS scenario FROM direct d),
            x AS (SELECT DISTINCT scenario, relationship_type, src_key, dst_key FROM w WHERE relationship_type IN ('LOGGED_INTO', 'ACCESSED')),
            y AS (SELECT DISTINCT scenario, relationship_type, src_key, dst_key FROM w WHERE relationship_type <> 'AUTHENTICATED_TO' AND event_id NOT IN (SELECT record FROM bad)),
            j AS (SELECT coalesce(x.scenario, y.scenario) AS scenario, x.src_key AS e, y.src_key AS p FROM x FULL JOIN y USING (scenario, relationship_type, src_key, dst_key))
            SELECT scenario, count(e) AS expected, count(p) AS produced, count(*) FILTER (e IS NOT NULL AND p IS NOT NULL) AS correct, count(*) FILTER (e IS NULL) AS unsupported, count(*) FILTER (p IS NULL) AS missed,
            count(*) FILTER (e IS NOT NULL AND p IS NOT NULL) / count(p) AS precision, count(*) FILTER (e IS NOT NULL AND p IS NOT NULL) / count(e) AS recall FROM j GROUP BY scenario"""
        ),
        "cor_15_repeated_sign_in": _matches("user", [("authenticate", "action = 'authenticate'", 0, None), *[("authenticate", "action = 'authenticate'", 172_800, None)] * 2, ("login", "action = 'login'", 86_400, "action = 'access'")]),
        "cor_15_lateral": _matches("host", [("login", "action = 'login'", 0, None), ("execute", "action = 'execute'", 7_200, None), ("connect", "action = 'connect'", 7_200, None)], 10_800),
        "cor_15_unannounced_access": _matches("host", [("connect", "action = 'connect' AND destination_host IS NOT NULL", 0, None), ("access", "action = 'access'", 21_600, "action = 'login'"), ("access", "action = 'access'", 21_600, None)]),
    }
    out["str_05_stream_sessions"] = out["tml_09_sessions"]
    return out | PIVOTS
