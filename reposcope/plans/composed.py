"""Registered queries that put several operators together, and the SQL of the same results."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.functions import paths
from reposcope.functions.text import findings_sql, positions_sql
from reposcope.operators import catalog, code, graph, lexical, link, reading, scan, schema
from reposcope.operators import journey_graph as jg
from reposcope.plans.more import _GATES, _INTER, _SROUTES, _TO, _on, _q
from reposcope.plans.queries import _ASKED, _ROUTES, _SERVED, ORACLE_SQL, ORACLE_SQL_BODY, QUERIES, register
from reposcope.sources.derived import stated
from reposcope.sources.tables import read_modules, shared_folder, write_modules
from reposcope.streaming import presence, recompute

# --- endpoint catalog -----------------------------------------------------------

_served = _on(_SERVED, "sources")
_signs = " OR ".join(f"contains(source, '{s}')" for s in catalog.SCHEMA_SIGNS)
_late = " OR ".join(f"contains(source[spot + 1 : spot + {catalog.REQUIRED_CHARS}], '{s}')" for s in catalog.REQUIRED)
_some = lambda words: " OR ".join(f"contains(lower(source), '{w}')" for w in words)
_supposed = " UNION ".join(f"SELECT repo_id, path, '{n}' AS name, 'string' AS type, {need} AS required FROM s WHERE NOT regexp_matches(source, {_q(catalog.FIELD)}) AND ({_some(w)})" for w, n, need in catalog.SUPPOSED)
_FIELDS = f"""s AS (SELECT DISTINCT repo_id, path, source FROM sources WHERE {_signs}),
f AS (SELECT repo_id, path, name, max_by(type, spot) AS type, max_by(required, spot) AS required FROM (SELECT repo_id, path, spot, regexp_extract(match, {_q(catalog.FIELD)}, 1) AS name,
    replace(regexp_extract(match, {_q(catalog.FIELD)}, 2), 'email', 'string') AS type, {_late} AS required FROM {positions_sql(catalog.FIELD, 's')}) GROUP BY ALL
  UNION ALL {_supposed})"""
register("c31_validation_fields", "sources", lambda m: catalog.schema_field_rows(m.filter(catalog._has(m["source"], catalog.SCHEMA_SIGNS))), f"WITH {_FIELDS} SELECT repo_id, path, name, type, required FROM f")


def _endpoints(files: DataFrame) -> DataFrame:
    return catalog.endpoint_catalog(scan.controllers(files), files)


register("c32_endpoint_catalog", "sources", _endpoints, f"""WITH {_FIELDS}, e AS (SELECT DISTINCT repo_id, route, path, string_split(path, '/') AS parts, unnest(string_split(methods, ',')) AS method FROM ({_served})),
n AS (SELECT *, CASE WHEN len(parts) > 1 AND parts[len(parts) - 1] <> '' THEN parts[len(parts) - 1] ELSE parts[len(parts)] END AS folder FROM e),
m AS (SELECT n.repo_id, n.method, n.route, n.path, min(s.path) AS schema_path FROM n LEFT JOIN s ON n.repo_id = s.repo_id AND (contains(s.source, n.route) OR contains(lower(s.path), n.folder)) WHERE method <> 'HANDLER' GROUP BY ALL),
g AS (SELECT repo_id, path, string_agg(name || ':' || type || CASE WHEN required THEN '!' ELSE '' END, ',' ORDER BY name || ':' || type || CASE WHEN required THEN '!' ELSE '' END) AS fields FROM f GROUP BY ALL)
SELECT m.repo_id, method, route, method || ' ' || route AS name, m.path, schema_path, CASE WHEN g.fields IS NOT NULL THEN 'schema' WHEN method IN ('POST', 'PUT', 'PATCH') THEN 'default' ELSE 'none' END AS body, coalesce(g.fields, '') AS fields
FROM m LEFT JOIN g ON g.repo_id = m.repo_id AND g.path = m.schema_path
UNION ALL SELECT repo_id, 'POST', route, 'HANDLER ' || route, path, NULL, 'login', 'email:string!,password:string!' FROM n WHERE method = 'HANDLER'""")


# --- journey graph ----------------------------------------------------------------

_signals, _tail = ORACLE_SQL_BODY["c26"].rsplit("SELECT DISTINCT repo_id, path,", 1)
_route = _tail[_tail.index("CASE WHEN") : _tail.index(" AS route")]
_leads = _tail[_tail.index("list_sort(list_distinct(") : _tail.index(", ',') AS decisions")]
_ordered = lambda x: f"list_filter({x}, lambda m, i: list_position({x}, m) = i)"
_named = " || ".join(f"list_filter(regexp_extract_all(source, {_q(p)}, 1), lambda m: m NOT IN ({', '.join(repr(n) for n in none) or repr('')}))" for p, none in code.MODELS)
_null = {"crud": "NULL::VARCHAR", "models": "NULL::VARCHAR[]", "targets": "NULL::VARCHAR[]", "trigger": "NULL::VARCHAR", "edge": "NULL::VARCHAR"}


def _made(kind: str, label: str, own: bool, **more: str) -> str:
    return "{'type': '" + kind + "', 'label': " + label + f", 'own': {own}, " + ", ".join(f"'{k}': {more.get(k, v)}" for k, v in _null.items()) + "}"


def _if(ask: str, node: str) -> str:
    return f"CASE WHEN {ask} THEN [{node}] ELSE [] END"


_stem = lambda other: f"coalesce(nullif(regexp_replace(string_split(path, '/')[-1], '\\.\\w+$', ''), ''), '{other}')"
_pick = lambda table: "CASE " + " ".join(f"WHEN contains(d, '{w}') THEN '{v}'" for w, v in table) + " END"
_of_package = " || ".join(
    [_if(f"({_pick(t)}) IS NOT NULL", _made(k, _pick(t), False)) for k, t in (("database", jg.DATABASES), ("cache", jg.CACHES))]
    + [_if(f"contains(d, '{w}')", _made("external_service", f"'External: {v}'", False)) for w, v in jg.EXTERNALS]
    + [_if(" OR ".join(f"contains(d, '{w}')" for w in jg.OAUTH_PACKAGES), _made("auth", f"'{jg.OAUTH}'", True)), _if(f"({_pick(jg.SERVICES)}) IS NOT NULL", _made("service", _pick(jg.SERVICES), False))]
)
_pieces = " || ".join(
    [
        _if("auth", _made("auth", "coalesce('Auth: ' || route, 'Auth Login')", True)), _if("logout", _made("logout", "'Logout'", True)), _if("validation", _made("validation", f"'Validate: ' || {_stem('validate')}", True)),
        _if("len(decisions) > 0 AND route IS NOT NULL", _made("decision", "'Choose: ' || route", True, targets="decisions")),
        _if("api", _made("action", f"crud || ': ' || coalesce(route, {_stem('API Action')})", True, crud="crud", models="models")),
        f"flatten(list_transform(list_filter(packages, lambda d: {' OR '.join(f"contains(d, '{p}')" for p in jg.PACKAGES)}), lambda d: {_of_package}))",
        _if("middleware", _made("middleware", f"'Auth Guard: ' || {_stem('middleware')}", False)),
        "list_transform(services, lambda x: " + _made("external_service", "'External: ' || upper(x[1]) || x[2:]", False) + ")",
        _if("background_service", _made("service", f"'Service: ' || {_stem('service')}", False)), _if("error_handler", _made("error_handler", f"'Error Handler: ' || {_stem('error')}", False)), _if("cache", _made("cache", f"'Cache: ' || {_stem('cache')}", False)),
        "list_transform(stores, lambda x: " + _made("database", "string_split(x, '|')[2]", False, trigger="string_split(x, '|')[1]", edge="string_split(x, '|')[3]") + ")",
        _if("database AND NOT api", _made("database", f"'DB: ' || {_stem('Database')}", False)),
        _if("route IS NOT NULL AND NOT landing AND NOT auth AND NOT logout AND NOT api", _made("page", "route", False)),
    ]
)
_section = "CASE " + " ".join(f"WHEN {sign} THEN '{name}'" for sign, name in jg.FILE_SECTIONS) + " WHEN route IS NOT NULL THEN 'entry' ELSE 'misc' END"
_fixed = lambda kind, label, phase, place, table: f"SELECT repo_id, '{kind}::{label}', '{kind}', '{label}', '', NULL, {phase}, {place}, {', '.join(_null.values())} FROM {table}"
_kinds = ["auth", "logout", "validation", "action", "database", "page", "middleware", "error_handler", "cache"]
_ends = ", ".join(f"arg_{a}(node_id, (path, place)) FILTER (type = '{k}' AND phase = 1) AS {n}_{k}" for k in _kinds for n, a in (("first", "min"), ("last", "max")))
_by_type = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in jg.TYPE_SECTIONS.items()) + " ELSE 'misc' END"
_label_of = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in jg.SECTION_LABELS.items()) + " END"
_tree = f"kind NOT IN ({', '.join(repr(k) for k in jg.CONVERGING)}) AND NOT regexp_matches(kind, {_q(jg.CONVERGING_CRUD)})"
_here = "coalesce(last_database, last_action, last_walk, entered)"


def _edge(stage: str, src: str, dst: str, kind: str, rows: str, sub: str = "'0'", of_file: bool = True) -> str:
    where = "path, place" if of_file else "'' AS path, 0 AS place"
    return f"SELECT repo_id, {src} AS src, {dst} AS dst, {kind} AS kind, {stage} AS stage, {where}, {sub} AS sub FROM {rows}"


def _chain(stage: int, kind: str, label: str) -> str:
    return _edge(str(stage), "node_id", "next", f"'{label}'", f"(SELECT *, lead(node_id) OVER (PARTITION BY repo_id ORDER BY path, place) AS next FROM n WHERE phase = 1 AND type = '{kind}')")


_each = lambda kind: f"(SELECT n.*, a.* EXCLUDE repo_id FROM n JOIN a USING (repo_id) WHERE phase = 1 AND type = '{kind}')"
_woven = "\nUNION ALL ".join(
    [
        _edge("10", "'start::Start'", "'page::Landing Page'", "'open app'", "a", of_file=False), _edge("20", "'page::Landing Page'", "node_id", "'needs login'", _each("auth")),
        _edge("20", "'page::Landing Page'", "first_page", "'browse'", "a WHERE first_auth IS NULL", of_file=False), _edge("30", "asks", "node_id", "'check'", "v"), _edge("30", "node_id", "asks", "'fail → retry'", "v", "'1'"),
        _edge("40", "entered", "first_walk", "'browse'", "a", of_file=False), _edge("50", "node_id", "dst", "'yes'", "l", "lpad(CAST(i AS VARCHAR), 9, '0')"), _edge("60 + paged", "node_id", "next", "'navigate'", "w"),
        _edge("70", "last_walk", "first_action", "'flow'", "a", of_file=False), _edge("80", "node_id", "first_action", "'select'", _each("decision")), _edge("80", "node_id", "first_action", "'select'", _each("page"), "'1'"),
        _chain(90, "action", "next"), _edge("100", "node_id", "dst", "crud || ' → ' || model", "u", "dst_order"), _edge("100", "node_id", "first_database", "'query'", f"{_each('action')} x ANTI JOIN u USING (repo_id, node_id)"),
        _edge("110", "coalesce(CASE WHEN trigger = 'update profile' THEN first_update ELSE first_create END, first_action)", "node_id", "edge", f"{_each('database')} WHERE trigger IS NOT NULL"),
        _chain(120, "middleware", "chain"), _edge("130", "node_id", "first_action", "'guard'", _each("middleware")), _edge("140", "first_auth", "first_middleware", "'protected by'", "a", of_file=False),
        _edge("150", "coalesce(first_action, first_walk)", "node_id", "CASE WHEN first_action IS NOT NULL THEN 'call external' ELSE 'integrate' END", _each("external_service")),
        _edge("160", "first_action", "node_id", "'enqueue'", _each("service")), _edge("160", "node_id", "CASE WHEN bus THEN 'service::Service Bus' ELSE first_database END", "CASE WHEN bus THEN 'publish' ELSE 'process' END", _each("service"), "'1'"),
        _edge("170", "'service::Service Bus'", "first_database", "'process'", "a WHERE bus", of_file=False), _edge("180", "first_action", "node_id", "'catch error'", _each("error_handler")), _edge("180", "node_id", "first_database", "'log'", _each("error_handler"), "'1'"),
        _chain(190, "cache", "chain"), _edge("200", "first_action", "first_cache", "'check cache'", "a", of_file=False), _edge("200", "first_cache", "first_database", "'cache miss'", "a", "'1'", False), _chain(210, "database", "relate"),
        _edge("220", "first_walk", "node_id", "'submit'", "iv"), _edge("220", "node_id", f"coalesce(first_action, first_logout, {_here})", "'valid'", "iv", "'1'"), _edge("220", "node_id", "first_error_handler", "'invalid → error'", "iv", "'2'"),
        _edge("230", _here, "first_logout", "'session end'", "a WHERE first_logout IS NOT NULL", of_file=False), _edge("240", f"coalesce(first_logout, {_here})", "'end::Loop'", "'complete'", "a", of_file=False),
        _edge("250", "'end::Loop'", "'page::Landing Page'", "'restart'", "a", of_file=False),
    ]
)
_JOURNEY = f"""{_signals}, g AS (SELECT DISTINCT * FROM (SELECT repo_id, path, {', '.join(jg.journey.SIGNALS)}, len(services) > 0 AS external_service, crud, {_route} AS route, {_leads} AS decisions, services,
  CASE WHEN len(found) = 0 AND crud = 'CREATE' THEN ['{'|'.join(jg.journey.PLAIN_STORE)}'] ELSE found END AS stores, packages, list_transform({_named}, lambda m: trim(translate(m, '-_', '  '))) AS raw_models FROM s)),
h AS (SELECT *, {_ordered("raw_models")} AS models FROM g),
k AS (SELECT repo_id, path, {_section} AS section, {_pieces} AS pieces FROM h),
e0 AS (SELECT repo_id, path, section, generate_subscripts(pieces, 1) - 1 AS place, unnest(pieces) AS x FROM k),
e1 AS (SELECT DISTINCT repo_id, path, section, place, x.* FROM e0),
e2 AS (SELECT *, row_number() OVER (PARTITION BY repo_id, type, label, CASE WHEN own THEN path ELSE '' END ORDER BY path, place) AS nth,
  type = 'auth' AND label = '{jg.OAUTH}' AND (path, place) > min(CASE WHEN type = 'auth' THEN (path, place) END) OVER (PARTITION BY repo_id) AS late FROM e1),
n1 AS (SELECT repo_id, type || ':' || label || CASE WHEN own THEN '@' || path ELSE '' END AS node_id, type, label, path, section, 1 AS phase, place, crud, models, targets, trigger, edge FROM e2 WHERE nth = 1 AND NOT coalesce(late, false)),
rp AS (SELECT DISTINCT repo_id FROM sources), bu AS (SELECT repo_id FROM n1 GROUP BY repo_id HAVING count(*) FILTER (type = 'service') > 1 AND count(*) FILTER (type = 'database') > 0),
n AS (SELECT * FROM n1 UNION ALL {_fixed('start', 'Start', 0, 0, 'rp')} UNION ALL {_fixed('page', 'Landing Page', 0, 1, 'rp')} UNION ALL {_fixed('service', 'Service Bus', 2, 0, 'bu')} UNION ALL {_fixed('end', 'Loop', 3, 0, 'rp')}),
a0 AS (SELECT repo_id, {_ends}, arg_min(node_id, (path, place)) FILTER (type = 'action' AND crud = 'CREATE') AS first_create, arg_min(node_id, (path, place)) FILTER (type = 'action' AND crud = 'UPDATE') AS first_update,
  arg_min(node_id, (type = 'page', path, place)) FILTER (phase = 1 AND type IN ('decision', 'page')) AS first_walk, arg_max(node_id, (type = 'page', path, place)) FILTER (phase = 1 AND type IN ('decision', 'page')) AS last_walk, bool_or(phase = 2) AS bus FROM n GROUP BY repo_id),
a AS (SELECT *, coalesce(CASE WHEN first_auth IS NOT NULL THEN coalesce(last_validation, last_auth) END, first_page, 'page::Landing Page') AS entered FROM a0),
oa AS (SELECT repo_id, path, arg_min(node_id, place) AS own_auth FROM n WHERE type = 'auth' GROUP BY ALL),
v AS (SELECT * FROM (SELECT x.*, coalesce(oa.own_auth, x.first_auth) AS asks FROM {_each('validation')} x LEFT JOIN oa USING (repo_id, path)) WHERE asks IS NOT NULL),
iv AS (SELECT * FROM {_each('validation')} x ANTI JOIN oa USING (repo_id, path) WHERE first_walk IS NOT NULL),
l AS (SELECT t.repo_id, t.node_id, t.path, t.place, t.i, p.node_id AS dst FROM (SELECT repo_id, node_id, path, place, generate_subscripts(targets, 1) - 1 AS i, unnest(targets) AS label FROM n WHERE type = 'decision') t JOIN n p ON p.repo_id = t.repo_id AND p.type = 'page' AND p.phase = 1 AND p.label = t.label),
w AS (SELECT *, lead(node_id) OVER (PARTITION BY repo_id ORDER BY paged, path, place) AS next FROM (SELECT repo_id, node_id, path, place, CAST(type = 'page' AS INTEGER) AS paged FROM n WHERE phase = 1 AND type IN ('decision', 'page')) x ANTI JOIN (SELECT repo_id, dst AS node_id FROM l) y USING (repo_id, node_id)),
u AS (SELECT repo_id, node_id, path, place, crud, dst, dst_order, arg_min(model, spot) AS model FROM (SELECT x.*, d.node_id AS dst, d.path || '|' || lpad(CAST(d.place AS VARCHAR), 9, '0') AS dst_order FROM
  (SELECT repo_id, node_id, path, place, crud, generate_subscripts(models, 1) AS spot, unnest(models) AS model FROM n WHERE type = 'action') x JOIN n d ON d.repo_id = x.repo_id AND d.type = 'database' AND x.model <> ''
  AND (contains(lower(d.label), x.model) OR contains(x.model, regexp_replace(lower(d.label), '^db:\\s*', '')))) GROUP BY ALL),
q0 AS ({_woven}), q AS (SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, src, dst, kind ORDER BY stage, path, place, sub) AS nth FROM q0 WHERE src IS NOT NULL AND dst IS NOT NULL) WHERE nth = 1),
pl AS (SELECT *, CASE WHEN type IN ('start', 'end', 'logout') THEN {_by_type} ELSE coalesce(section, {_by_type}) END AS home, CASE WHEN node_id = 'page::Landing Page' THEN 1 ELSE CASE type {' '.join(f"WHEN '{k}' THEN {x}" for k, (x, _) in jg.TYPES.items())} END END AS col FROM n),
cr AS (SELECT q.*, x.home AS sh, y.home AS dh, least(x.col, y.col) + 1 AS bcol FROM q JOIN pl x ON x.repo_id = q.repo_id AND x.node_id = q.src JOIN pl y ON y.repo_id = q.repo_id AND y.node_id = q.dst
  WHERE {_tree} AND src <> dst AND sh <> dh AND sh <> 'entry' AND dh <> 'entry' AND x.type NOT IN ('start', 'end') AND y.type NOT IN ('start', 'end')),
br AS (SELECT *, 'bridge:' || sh || ':' || dh AS bridge FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, sh, dh ORDER BY stage, path, place, sub, src, dst, kind) AS nth FROM cr) WHERE nth = 1),
an AS (SELECT repo_id, node_id, type, label, col, phase, path, place FROM pl UNION ALL SELECT repo_id, bridge, 'bridge', {_label_of('sh')} || ' → ' || {_label_of('dh')}, bcol, 4, lpad(CAST(stage AS VARCHAR), 3, '0') || '|' || path || '|' || lpad(CAST(place AS VARCHAR), 9, '0') || '|' || sub, 0 FROM br),
be AS (SELECT repo_id, src, dst, kind FROM q ANTI JOIN br USING (repo_id, src, dst, kind) UNION ALL SELECT repo_id, src, bridge, 'next section' FROM br UNION ALL SELECT repo_id, bridge, dst, 'next section' FROM br),
hd AS (SELECT repo_id, col, arg_min(node_id, (phase, path, place)) AS head, bool_or(type = 'end') AS is_end FROM an WHERE type <> 'bridge' GROUP BY ALL),
ae AS (SELECT * FROM be UNION SELECT x.repo_id, coalesce((SELECT arg_max(head, hd.col) FROM hd WHERE hd.repo_id = x.repo_id AND hd.col < x.col), 'start::Start'), x.node_id, 'flow' FROM an x ANTI JOIN (SELECT repo_id, dst AS node_id FROM be WHERE {_tree}) t USING (repo_id, node_id) WHERE type NOT IN ('bridge', 'start')
  UNION SELECT x.repo_id, x.node_id, coalesce((SELECT arg_min(head, hd.col) FROM hd WHERE hd.repo_id = x.repo_id AND hd.col > x.col AND NOT is_end), 'end::Loop'), 'flow' FROM an x ANTI JOIN (SELECT repo_id, src AS node_id FROM be WHERE {_tree}) t USING (repo_id, node_id) WHERE type NOT IN ('bridge', 'end'))
"""
register("g16_journey_nodes", "sources", lambda m: jg.journey_graph(m)[0], f"""{_JOURNEY} SELECT repo_id, node_id, type, label, CASE type {' '.join(f"WHEN '{k}' THEN '{x}'" for k, (_, x) in jg.TYPES.items())} END AS shape, CAST(col AS INTEGER) AS col,
  CAST(row_number() OVER (PARTITION BY repo_id, col ORDER BY phase, path, place, node_id) - 1 AS INTEGER) AS row, CASE WHEN phase = 1 THEN path END AS path FROM an""")
register("g16_journey_graph", "sources", lambda m: jg.journey_graph(m)[1], f"{_JOURNEY} SELECT repo_id, src, dst, kind FROM ae")


# --- schemas of several dialects ----------------------------------------------------

_raw = "upper(regexp_extract(body, '^\\w+', 0))"
_universal = "CASE " + " ".join(f"WHEN {_raw} IN ({', '.join(repr(n) for n in names)}) THEN '{kind}'" for kind, names in schema.UNIVERSAL.items()) + f" ELSE {_raw} END"
_CATALOG = f"""WITH d AS ({_on(ORACLE_SQL_BODY['h1'], 'ddl_files')}), f AS (SELECT x.*, d.dialect, regexp_extract(chr(10) || source, '\\nCREATE TABLE `?(\\w+)', 1) AS table_name, nullif(regexp_extract(source, 'ENGINE=(\\w+)', 1), '') AS engine,
  regexp_extract(source, 'UNIQUE KEY `\\w+` \\(`(\\w+)', 1) AS alone, regexp_extract(source, 'FOREIGN KEY \\(`?(\\w+)', 1) AS referring, regexp_extract(source, 'FOREIGN KEY \\S+ REFERENCES `?(\\w+)', 1) AS target, regexp_extract(source, 'FOREIGN KEY \\S+ REFERENCES \\S+? ?\\(`?(\\w+)', 1) AS target_column
  FROM ddl_files x JOIN d USING (repo_id, path)),
l AS (SELECT *, generate_subscripts(string_split(source, chr(10)), 1) AS i, unnest(string_split(source, chr(10))) AS line FROM f),
c AS (SELECT * EXCLUDE (source, i, line), CAST(row_number() OVER (PARTITION BY repo_id, path ORDER BY i) - 1 AS INTEGER) AS pos, regexp_extract(line, '^  `?(\\w+)', 1) AS name, regexp_replace(regexp_extract(line, '^  `?\\w+`? (.*)$', 1), '#.*', '') AS body FROM l WHERE regexp_matches(line, '^  `?\\w+`? ') AND NOT regexp_matches(line, '^  (UNIQUE|CONSTRAINT)')),
k AS (SELECT repo_id, path, table_name, engine, dialect, pos, name, regexp_extract(body, '^\\w+(\\([^)]*\\))?', 0) AS raw_type, {_universal} AS type, contains(body, 'PRIMARY KEY') AS pk, contains(body, ' UNIQUE') OR alone = name AS is_unique, NOT contains(body, 'NOT NULL') AND NOT contains(body, 'PRIMARY KEY') AS nullable,
  CASE WHEN referring = name THEN target ELSE nullif(regexp_extract(body, 'REFERENCES (\\w+)', 1), '') END AS ref_table, CASE WHEN referring = name THEN target_column ELSE nullif(regexp_extract(body, 'REFERENCES \\w+\\((\\w+)', 1), '') END AS ref_column,
  regexp_matches(body, 'AUTO_?INCREMENT') OR dialect = 'postgresql' AND contains(body, 'SERIAL') AS auto_increment FROM c)
"""
register("h3_schema_catalog_dialects", "ddl_files", lambda d: schema.schema_catalog(d).drop("table_no"), f"{_CATALOG} SELECT * FROM k")
register("d25_fk_edges_dialects", "ddl_files", lambda d: schema.foreign_keys(schema.schema_catalog(d)), f"{_CATALOG} SELECT repo_id, path, table_name AS src, name AS src_column, ref_table AS dst, ref_column AS dst_column, CASE WHEN is_unique THEN 'one-to-one' ELSE 'one-to-many' END AS cardinality FROM k WHERE ref_table IS NOT NULL")
_translated = "CASE upper(type) " + " ".join(f"WHEN '{u}' THEN '{t}'" for u, t in schema.NATIVE["sqlite"].items()) + " ELSE 'TEXT' END"
_quoted = "chr(34) || {} || chr(34)"
register("a9_export_ddl_dialects", "ddl_files", lambda d: schema.export_ddl(schema.schema_catalog(d), "sqlite").select("repo_id", "path", "table_name", "ddl"), f"""{_CATALOG}
SELECT repo_id, path, table_name, 'CREATE TABLE ' || {_quoted.format('table_name')} || ' (' || chr(10) || string_agg('  ' || {_quoted.format('name')} || ' ' || {_translated} || CASE WHEN pk THEN ' PRIMARY KEY' WHEN nullable THEN '' ELSE ' NOT NULL' END || CASE WHEN is_unique AND NOT pk THEN ' UNIQUE' ELSE '' END
  || CASE WHEN ref_table IS NOT NULL THEN ' REFERENCES ' || {_quoted.format('ref_table')} || '(' || {_quoted.format('ref_column')} || ')' ELSE '' END, ',' || chr(10) ORDER BY pos) || chr(10) || ');' AS ddl FROM k GROUP BY repo_id, path, table_name""")


# --- presence ---------------------------------------------------------------------------

#: How late an event may come in the registered stream, and after how long without one a user is gone.
_LATE, _STALE = 600, 30000.0


def _pings(events: DataFrame) -> DataFrame:
    """Events as pings: errors as leaves, all others as signs of life."""
    return events.select(F.concat(F.lit("r"), F.col("user_id") % 10).alias("project_id"), F.concat(F.lit("n"), "user_id").alias("user_id"), F.when(F.col("event_type") == "error", "leave").otherwise("move").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def _presence_batch(events: DataFrame) -> DataFrame:
    clock = events.agg((F.max(F.col("ts").cast("timestamp")) - F.expr(f"INTERVAL {_LATE} SECONDS")).alias("clock"))
    pings = _pings(events).crossJoin(F.broadcast(clock))  # one row
    return presence.presence_events(pings, F.col("clock"), _STALE).select("project_id", "user_id", "event", F.unix_micros("ts").alias("micros"))


def _presence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream, to its end."""
    path = f"{sf_dir}/events.parquet"
    # a pattern may stand for one file as well as for a folder of them
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    return presence.told_so_far(_pings(stream), f"{_LATE} seconds", _STALE).select("project_id", "user_id", "event", F.unix_micros("ts").alias("micros"))


_PRESENCE = f"""WITH p AS (SELECT 'r' || CAST(user_id % 10 AS VARCHAR) AS project_id, 'n' || CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'error' THEN 'leave' ELSE 'move' END AS kind, epoch_us(ts) AS at_us FROM events),
c AS (SELECT max((at_us // 1000) * 1000) - {_LATE} * 1000000 AS clock FROM p), w AS (SELECT p.*, clock, lag(at_us) OVER u AS before, lag(kind) OVER u AS was, lead(at_us) OVER u IS NULL AS newest FROM p, c WHERE at_us <= clock WINDOW u AS (PARTITION BY project_id, user_id ORDER BY at_us, kind)),
s AS (SELECT *, coalesce(was = 'move' AND at_us - before <= {int(_STALE * 1_000_000)}, false) AS alive FROM w)
SELECT project_id, user_id, 'expire' AS event, before + {int(_STALE * 1_000_000)} AS micros FROM s WHERE was = 'move' AND NOT alive UNION ALL SELECT project_id, user_id, 'leave', at_us FROM s WHERE kind = 'leave' AND alive
UNION ALL SELECT project_id, user_id, 'join', at_us FROM s WHERE kind = 'move' AND NOT alive UNION ALL SELECT project_id, user_id, 'expire', at_us + {int(_STALE * 1_000_000)} FROM s WHERE newest AND kind = 'move' AND clock - at_us > {int(_STALE * 1_000_000)}"""
register("k3_presence_events", "events", _presence_batch, _PRESENCE)
register("k3_presence_stream", "", lambda: None, _PRESENCE)
QUERIES["k3_presence_stream"] = _presence_stream


# --- pages read with their imports ---------------------------------------------------------

_walks = lambda sql: sql.replace("screens", "walks").replace("FROM modules", "FROM walks")
_by_rank = " UNION ALL ".join(f"SELECT repo_id, path, {k} AS k, found1 AS specifier, CAST(line AS INTEGER) AS line FROM {findings_sql(p, 1, 'walks')}" for k, p in enumerate((scan.IMPORT, scan.REQUIRE)))
_extension = "CASE " + " ".join(f"WHEN ends_with(path, '.{e}') THEN {i}" for i, e in enumerate(link.EXTENSIONS)) + " END"
# imports of this table begin with ./ or @/ and name a file without its extension
_READ = f"""im AS (SELECT repo_id, path, specifier, min((k, line)) AS at_line, CASE WHEN starts_with(specifier, '@/') THEN 'src/' || specifier[3:] ELSE regexp_replace(path, '[^/]*$', '') || specifier[3:] END AS stem FROM ({_by_rank}) WHERE regexp_matches(specifier, '^(\\./|@/)') GROUP BY ALL),
st AS (SELECT repo_id, regexp_replace(path, '\\.[^.]*$', '') AS stem, min_by(path, {_extension}) AS target FROM walks WHERE {_extension} IS NOT NULL GROUP BY ALL),
ed AS (SELECT im.repo_id, im.path, st.target, row_number() OVER (PARTITION BY im.repo_id, im.path ORDER BY at_line, specifier) AS nth FROM im JOIN st USING (repo_id, stem)),
ln AS (SELECT DISTINCT repo_id, path, 1 + length(source) - length(replace(source, chr(10), '')) AS lines FROM walks WHERE source <> ''),
pg AS (SELECT repo_id, path AS page_path, route AS page FROM ({_walks(_SROUTES)})),
wk AS (SELECT repo_id, page_path, page_path AS path, [0] AS way, [page_path] AS seen FROM pg UNION ALL SELECT wk.repo_id, wk.page_path, ed.target, list_append(way, ed.nth), list_append(seen, ed.target) FROM wk JOIN ed ON ed.repo_id = wk.repo_id AND ed.path = wk.path WHERE len(way) <= {reading.DEPTH} AND NOT list_contains(seen, ed.target)),
rd AS (SELECT repo_id, page_path, path, CAST(row_number() OVER w - 1 AS INTEGER) AS position, CAST(coalesce(sum(lines + 1) OVER (PARTITION BY repo_id, page_path ORDER BY way ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS "offset"
  FROM (SELECT repo_id, page_path, path, min(way) AS way FROM wk GROUP BY ALL) JOIN ln USING (repo_id, path) WINDOW w AS (PARTITION BY repo_id, page_path ORDER BY way))"""


def _orders(files: DataFrame) -> DataFrame:
    return reading.reading_order(files, paths.crawl_routes(files).select("repo_id", "path"))


register("g6_reading_order", "walks", _orders, f"WITH RECURSIVE {_READ} SELECT * FROM rd")
_said = "CASE by_kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reading.LABELS.items()) + " END"
_here = "page_path || ':' || by_kind || ':' || target || ':' || line"
_PAGES_READ = f"""WITH RECURSIVE {_READ}, ev AS (SELECT DISTINCT i.repo_id, r.page_path, pg.page, i.kind AS by_kind, i.target, i.line + r."offset" AS line FROM ({_walks(_INTER)}) i JOIN rd r USING (repo_id, path) JOIN pg USING (repo_id, page_path)),
ld AS (SELECT ev.*, nullif(t.route, ev.page) AS route FROM ev LEFT JOIN ({_walks(_TO)}) t USING (repo_id, target)),
gt AS (SELECT g.repo_id, r.page_path, g.rank, g.kind AS gate, g.label AS gate_label, g.line + r."offset" AS gate_line FROM ({_walks(_GATES)}) g JOIN rd r USING (repo_id, path)),
ga AS (SELECT * FROM (SELECT ld.*, gate_label, gate_line, row_number() OVER (PARTITION BY ld.repo_id, ld.page_path, by_kind, target, ld.line ORDER BY rank, gate_line, gate, gate_label) AS nth FROM ld JOIN gt USING (repo_id, page_path) WHERE route IS NOT NULL AND gate_line < line) WHERE nth = 1),
op AS (SELECT * FROM ld ANTI JOIN ga USING (repo_id, page_path, by_kind, target, line)),
sg AS (SELECT DISTINCT s.repo_id, r.page_path, pg.page, s.candidate FROM (SELECT DISTINCT repo_id, path, found1 AS candidate FROM {findings_sql(scan.ROUTE_STRING, 1, 'walks')} WHERE NOT regexp_matches(found1, '(?i)\\.[a-z0-9]{{2,5}}$') AND NOT starts_with(found1, '//') AND length(found1) <= 100) s JOIN rd r USING (repo_id, path) JOIN pg USING (repo_id, page_path)
  ANTI JOIN (SELECT repo_id, page_path FROM ev WHERE by_kind IN ('link', 'router-push')) l ON l.repo_id = s.repo_id AND l.page_path = r.page_path ANTI JOIN (SELECT repo_id, page_path, target FROM ev) x ON x.repo_id = s.repo_id AND x.page_path = r.page_path AND x.target = s.candidate),
mt AS (SELECT sg.*, p.page AS route, row_number() OVER (PARTITION BY sg.repo_id, sg.page_path, sg.candidate ORDER BY CASE WHEN p.page = candidate THEN 1 ELSE 3 END, length(p.page) DESC, p.page) AS nth FROM sg JOIN pg p ON p.repo_id = sg.repo_id AND p.page <> '/' AND (p.page = candidate OR starts_with(candidate, p.page || '/')))
"""
register("g20_page_graph", "walks", lambda m: reading.page_graph(m)[1], f"""{_PAGES_READ}
SELECT repo_id, 'page:' || page AS src, 'gate:' || {_here} AS dst, 'action' AS kind, CASE WHEN by_kind LIKE 'on-%' THEN 'Submit' ELSE {_said} END AS label FROM ga UNION SELECT repo_id, 'gate:' || {_here}, 'page:' || route, 'success', 'Success Path' FROM ga UNION SELECT repo_id, 'gate:' || {_here}, 'error:' || {_here}, 'failure', 'Failure Path' FROM ga
UNION SELECT repo_id, 'page:' || page, 'action:' || {_here}, 'action', {_said} FROM op WHERE by_kind LIKE 'on-%' UNION SELECT repo_id, 'action:' || {_here}, 'page:' || route, 'navigation', 'Navigate' FROM op WHERE by_kind LIKE 'on-%' AND route IS NOT NULL
UNION SELECT repo_id, 'page:' || page, 'page:' || route, 'navigation', {_said} FROM op WHERE by_kind NOT LIKE 'on-%' AND route IS NOT NULL UNION SELECT repo_id, 'page:' || page, 'page:' || route, 'reference', 'Reference' FROM mt WHERE nth = 1 AND route <> page""")
register("g20_page_nodes", "walks", lambda m: reading.page_graph(m)[0], f"""{_PAGES_READ}
SELECT repo_id, 'page:' || page AS node_id, 'page' AS type, page AS label, CAST(NULL AS INTEGER) AS line FROM pg UNION SELECT repo_id, 'gate:' || {_here}, 'validation', gate_label, gate_line FROM ga UNION SELECT repo_id, 'error:' || {_here}, 'action', 'Error Response', gate_line FROM ga
UNION SELECT repo_id, 'action:' || {_here}, 'action', CASE by_kind WHEN 'on-click' THEN 'Trigger Action' ELSE 'Trigger Redirection' END, line FROM op WHERE by_kind LIKE 'on-%'""")


# --- deletions, from every node whose number is divisible by 50 --------------------------------

_radius = ORACLE_SQL_BODY["g1"]
_origins = "o AS (SELECT repo_id, node_id AS origin FROM nodes WHERE CAST(node_id[2:] AS BIGINT) % 50 = 0)"


def _way(name: str, a: str, b: str) -> str:
    """CTEs of the depths from the origins along the edges, of the smallest node before each, and of the ways."""
    return f"""{name}d AS (SELECT repo_id, origin, origin AS node_id, 0 AS d FROM o UNION SELECT x.repo_id, x.origin, e.{b}, x.d + 1 FROM {name}d x JOIN edges e ON e.repo_id = x.repo_id AND e.{a} = x.node_id WHERE x.d < 50),
{name}m AS (SELECT repo_id, origin, node_id, min(d) AS d FROM {name}d GROUP BY ALL),
{name}p AS (SELECT y.repo_id, y.origin, y.node_id, y.d, min(x.node_id) AS before FROM {name}m y JOIN edges e ON e.repo_id = y.repo_id AND e.{b} = y.node_id JOIN {name}m x ON x.repo_id = y.repo_id AND x.origin = y.origin AND x.node_id = e.{a} AND x.d = y.d - 1 GROUP BY ALL),
{name}w AS (SELECT repo_id, origin, origin AS node_id, 0 AS d, origin AS path FROM o UNION ALL SELECT y.repo_id, y.origin, y.node_id, y.d, w.path || '>' || y.node_id FROM {name}w w JOIN {name}p y ON y.repo_id = w.repo_id AND y.origin = w.origin AND y.before = w.node_id)"""


_BROKEN = "SELECT DISTINCT o.repo_id, o.origin, e.src, e.dst, e.kind FROM o JOIN edges e ON e.repo_id = o.repo_id AND (e.src = o.origin OR e.dst = o.origin)"
register("g1_impact_paths", "nodes edges", lambda n, e: graph.impacts(n.filter(_ASKED), n, e), f"""WITH RECURSIVE {_origins}, {_way('f', 'src', 'dst')}, {_way('b', 'dst', 'src')}
SELECT f.repo_id, f.origin, f.node_id, CASE WHEN d = 1 THEN 'direct' ELSE 'transitive' END AS category, d AS depth, path, coalesce(n.shape IN ('pill', 'rectangle'), false) AS is_route FROM fw f LEFT JOIN nodes n ON n.repo_id = f.repo_id AND n.node_id = f.node_id WHERE d > 0
UNION ALL SELECT b.repo_id, b.origin, b.node_id, 'orphaned-by-deletion', d, path, false FROM bw b ANTI JOIN fw f USING (repo_id, origin, node_id) WHERE d > 0""")
register("g1_broken_edges", "nodes edges", lambda n, e: graph.broken_edges(n.filter(_ASKED), e), f"WITH {_origins} {_BROKEN}")
register("f13_deletion_summary", "nodes edges", lambda n, e: graph.deletion_summary(n.filter(_ASKED), n, e), f"""WITH RECURSIVE {_origins}, i AS ({_radius}), b AS (SELECT repo_id, origin, count(*) AS broken FROM ({_BROKEN}) GROUP BY ALL),
c AS (SELECT i.repo_id, i.origin, count(*) AS impacted, count(*) FILTER (n.shape = 'pill') AS routes, count(*) FILTER (n.shape = 'rectangle') AS services FROM i LEFT JOIN nodes n ON n.repo_id = i.repo_id AND n.node_id = i.node_id GROUP BY ALL)
SELECT o.repo_id, o.origin, coalesce(impacted, 0) AS impacted, coalesce(routes, 0) AS routes, coalesce(services, 0) AS services, coalesce(broken, 0) AS broken FROM o LEFT JOIN c USING (repo_id, origin) LEFT JOIN b USING (repo_id, origin)""")


# --- pushes and recomputed repositories ----------------------------------------------------------


def _pushed(changes: DataFrame) -> DataFrame:
    """Mutations of ten events a push and three a commit, on the nodes of every fourth file and some others."""
    file = F.struct("event_id", F.struct("path", "change").alias("f"))
    commits = changes.groupBy("repo_id", F.expr("event_id div 10").alias("push"), F.expr("event_id div 3").alias("c")).agg(F.sort_array(F.collect_list(file)).alias("files"))
    ordered = commits.groupBy("repo_id", "push").agg(F.sort_array(F.collect_list(F.struct("c", F.transform("files", lambda x: x["f"]).alias("files")))).alias("cs"))
    pushes = ordered.select("repo_id", F.col("push").alias("event_id"), F.transform("cs", lambda x: F.struct(x["files"].alias("files"))).alias("commits"))
    users = changes.select("repo_id", F.expr("cast(substring(node_id, 2) AS BIGINT)").alias("u")).distinct().filter("u % 4 = 0")
    nodes = users.select("repo_id", F.concat(F.lit("n"), "u").alias("node_id"), F.concat(F.lit("File"), "u").alias("label"))
    return recompute.commit_mutations(recompute.pushed_files(pushes), nodes).withColumn("node_id", F.when(F.col("action") != "add", F.col("node_id")))


register("k1_commit_mutations", "changes", _pushed, """WITH p AS (SELECT *, event_id // 10 AS push, event_id // 3 AS c, lower(path) AS w, string_split(string_split(lower(path), '/')[-1], '.')[1] AS stem FROM changes),
q AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY repo_id, push ORDER BY c) - 1 AS INTEGER) AS commit_no, CAST(row_number() OVER (PARTITION BY repo_id, push, c ORDER BY event_id) - 1 AS INTEGER) AS file_no FROM p),
n AS (SELECT DISTINCT repo_id, node_id, 'File' || node_id[2:] AS label FROM changes WHERE CAST(node_id[2:] AS BIGINT) % 4 = 0),
k AS (SELECT f.repo_id, f.w, min(n.node_id) AS node_id FROM (SELECT DISTINCT repo_id, w, stem FROM q) f JOIN n ON n.repo_id = f.repo_id AND (contains(lower(n.label), f.stem) OR contains(f.w, lower(n.label))) GROUP BY ALL)
SELECT q.repo_id, push AS event_id, commit_no, file_no, CASE change WHEN 'added' THEN 'add' WHEN 'deleted' THEN 'delete' ELSE 'update' END AS action, CASE WHEN change <> 'added' THEN k.node_id END AS node_id,
  CASE WHEN change = 'added' THEN m.label ELSE n.label END AS label
FROM q LEFT JOIN k USING (repo_id, w) LEFT JOIN n ON n.repo_id = q.repo_id AND n.node_id = k.node_id JOIN (SELECT event_id AS e, label FROM (""" + ORACLE_SQL_BODY["k1"] + """)) m ON m.e = q.event_id WHERE change = 'added' OR k.node_id IS NOT NULL""")


def _recomputed(files: DataFrame) -> DataFrame:
    """Imports of all repositories after pages of some are deleted and utilities rewritten, computed again for those only."""
    spark, folder = files.sparkSession, f"{shared_folder(files.sparkSession)}/recomputed/{uuid4().hex}"
    every = files.groupBy("repo_id", "path").agg(F.min("source").alias("source"))
    jobs = {"imports": link.import_edges}
    at = lambda rows, k: rows.select("repo_id", "path", "source", F.lit(k).alias("ts"), F.lit(k).alias("event_id"))
    recompute.recompute(spark, folder, at(every, 0), jobs)
    some = every.filter("repo_id IN ('r1', 'r2', 'r3')")
    pages = some.filter("path LIKE '%page.tsx'").withColumn("source", F.lit(None).cast("string"))
    tools = some.filter("path LIKE 'src/lib/%'").withColumn("source", F.concat(F.lit('import { x } from "@/components/Card1";\n'), "source"))
    recompute.recompute(spark, folder, at(pages.unionByName(tools), 1), jobs)
    return recompute.read_repositories(spark, f"{folder}/imports", link.import_edges(files).schema)


_CHANGED = """(SELECT repo_id, path, CASE WHEN repo_id IN ('r1', 'r2', 'r3') AND path LIKE 'src/lib/%' THEN 'import { x } from "@/components/Card1";' || chr(10) || source ELSE source END AS source FROM (SELECT repo_id, path, min(source) AS source FROM modules GROUP BY ALL) WHERE NOT (repo_id IN ('r1', 'r2', 'r3') AND path LIKE '%page.tsx'))"""
register("k5_recomputed_imports", "modules", _recomputed, ORACLE_SQL_BODY["d2"].replace("FROM modules", f"FROM {_CHANGED}"))


# --- token classes ---------------------------------------------------------------------------------


def _letters(pattern: str, keywords: list[str], word: str, comments: list[str]) -> str:
    """The letters of a text's token classes for DuckDB."""
    listed = ", ".join(f"'{k}'" for k in keywords)
    starts = " OR ".join(f"starts_with(t, '{c}')" for c in comments)
    signs = ", ".join(f"'{p}'" for p in lexical.PUNCTUATION)
    kinds = f"""CASE WHEN {starts} THEN 'c' WHEN t[1] IN (chr(39), '"', '`') THEN 's' WHEN regexp_matches(t, '^\\.?[0-9]') THEN 'n'
      WHEN regexp_matches(t, '^[a-zA-Z_$]') THEN CASE WHEN {word} IN ({listed}) THEN 'k' ELSE 'i' END WHEN t IN ('{{', '}}') THEN 'b' WHEN t IN ({signs}) THEN 'p' ELSE 'o' END"""
    return f"array_to_string(list_transform(regexp_extract_all(coalesce(source, ''), {_q(pattern)}), lambda t: {kinds}), '')"


def _classes(table: str) -> str:
    sql = f"(regexp_matches(trim(coalesce(source, '')), {_q(lexical.SQL_SIGNS[0])}) OR regexp_matches(coalesce(source, ''), {_q(lexical.SQL_SIGNS[1])}))"
    both = f"CASE WHEN {sql} THEN {_letters(lexical.SQL_TOKEN, lexical.SQL_KEYWORDS, 'upper(t)', ['//', '/*', '--'])} ELSE {_letters(lexical.JS_TOKEN, lexical.JS_KEYWORDS, 't', ['//', '/*'])} END"
    counts = ", ".join(f"CAST(length(letters) - length(replace(letters, '{k}', '')) AS BIGINT) AS {name}" for name, k in lexical.CLASSES.items())
    return f"SELECT repo_id, path, language, {counts} FROM (SELECT repo_id, path, CASE WHEN {sql} THEN 'sql' ELSE 'javascript' END AS language, {both} AS letters FROM {table})"


def _token_classes(files: DataFrame) -> DataFrame:
    return lexical.token_classes(files, ["repo_id", "path"])


register("c19_token_classes", "sources", _token_classes, _classes("sources"))
register("c19_token_classes_sql", "ddl_files", _token_classes, _classes("ddl_files"))


# --- settings, sections, flows ------------------------------------------------------------------------

_NAMES = " UNION ALL ".join(
    f"SELECT repo_id, path, '{prefix}' || found1 AS name, {k} AS rank, '{context}' AS context, line FROM {findings_sql(p, 1, 'code_and_sources')}"
    for k, (context, p, prefix) in enumerate([("process.env", scan.ENV, ""), ("import.meta.env", scan.META_ENV, "VITE_"), *[("config-key", p, "") for p in scan.CONFIG_KEYS]])
)
register("c15_env_scan", "sources code", lambda a, b: scan.env_scan(a.unionByName(b)), f"""WITH code_and_sources AS (SELECT * FROM sources UNION ALL SELECT * FROM code), x AS ({_NAMES}), o AS (SELECT DISTINCT repo_id, path, found1 AS name FROM {findings_sql(scan.ENV_DEFAULT, 1, 'code_and_sources')})
SELECT x.repo_id, x.path, x.name, context, CAST(line AS INTEGER) AS line, o.name IS NULL AS required FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, name ORDER BY rank, line, context) AS nth FROM x) x LEFT JOIN o USING (repo_id, path, name) WHERE nth = 1""")


def _homes_left(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    return graph.delete_sections(link.assign_section(nodes, sections), sections.filter("section_id LIKE '%1'"))


register("a11_delete_sections", "nodes sections", _homes_left, f"SELECT repo_id, node_id, CASE WHEN section_id NOT LIKE '%1' THEN section_id END AS section_id FROM ({ORACLE_SQL_BODY['d22']})")
_steps = ORACLE_SQL_BODY["g2"]
_around = f"""cy AS (SELECT DISTINCT repo_id, node_id FROM ({ORACLE_SQL_BODY['g4']})), bk AS (SELECT repo_id, node_id FROM cy UNION SELECT e.repo_id, e.src FROM bk JOIN edges e ON e.repo_id = bk.repo_id AND e.dst = bk.node_id)"""
register("g2_flow_summary", "nodes edges", lambda n, e: graph.flow_summary(n.filter(_ASKED), n, e), f"""WITH RECURSIVE {_around}, tr AS ({_steps})
SELECT tr.repo_id, origin, direction, count(*) AS steps, count(*) FILTER (is_exit) AS exits, max(depth) AS max_depth, bool_or(bk.node_id IS NOT NULL) AS has_cycles FROM tr LEFT JOIN bk ON bk.repo_id = tr.repo_id AND bk.node_id = tr.origin GROUP BY ALL""")
_some = "(SELECT * FROM nodes WHERE type IN ('view', 'controller'))"
register("g2_flow_summary_of_types", "nodes edges", lambda n, e: graph.flow_summary(n.filter(_ASKED), n, e, ["view", "controller"]), f"""WITH RECURSIVE {_around}, tr AS ({_steps.replace('JOIN nodes a', f'JOIN {_some} a').replace('JOIN nodes b', f'JOIN {_some} b').replace('FROM nodes,', f'FROM {_some} AS nodes,')})
SELECT tr.repo_id, origin, direction, count(*) AS steps, count(*) FILTER (is_exit) AS exits, max(depth) AS max_depth, bool_or(bk.node_id IS NOT NULL) AS has_cycles FROM tr LEFT JOIN bk ON bk.repo_id = tr.repo_id AND bk.node_id = tr.origin GROUP BY ALL""")


# --- SQL of queries registered elsewhere -----------------------------------------------------------------

_imported = f"""imp AS MATERIALIZED (SELECT DISTINCT repo_id, path, target FROM ({ORACLE_SQL_BODY['d2']}) WHERE target IS NOT NULL),
t AS (SELECT repo_id, path AS origin, path AS node_id, 0 AS d FROM ({_ROUTES}) UNION SELECT t.repo_id, t.origin, i.target, t.d + 1 FROM t JOIN imp i ON i.repo_id = t.repo_id AND i.path = t.node_id WHERE t.d < 5),
m AS (SELECT repo_id, origin, node_id, min(d) AS depth FROM t GROUP BY ALL)"""
ORACLE_SQL["g6_import_closure"] = stated(f"WITH RECURSIVE {_imported} SELECT repo_id, origin, node_id, depth FROM m")
ORACLE_SQL["f7_shared_components"] = stated(f"""WITH RECURSIVE {_imported}, u AS (SELECT repo_id, node_id, count(DISTINCT origin) AS usage_count FROM m WHERE depth > 0 GROUP BY ALL HAVING count(DISTINCT origin) > 1)
SELECT DISTINCT m.repo_id, m.node_id, u.usage_count, m.origin AS used_by FROM m JOIN u USING (repo_id, node_id) WHERE m.depth > 0""")
# paths of any length are enumerated by their length only, and only among nodes that no cycle leads to
_layers = f"""cy AS (SELECT DISTINCT repo_id, node_id FROM ({ORACLE_SQL_BODY['g4']})), bh AS (SELECT repo_id, node_id FROM cy UNION SELECT e.repo_id, e.dst FROM bh JOIN edges e ON e.repo_id = bh.repo_id AND e.src = bh.node_id),
fr AS (SELECT DISTINCT e.repo_id, e.src, e.dst FROM edges e ANTI JOIN bh ON bh.repo_id = e.repo_id AND bh.node_id = e.dst WHERE e.src <> e.dst),
ly AS (SELECT n.repo_id, n.node_id, 0 AS d FROM nodes n ANTI JOIN (SELECT repo_id, dst AS node_id FROM edges WHERE src <> dst) e USING (repo_id, node_id) UNION SELECT ly.repo_id, fr.dst, ly.d + 1 FROM ly JOIN fr ON fr.repo_id = ly.repo_id AND fr.src = ly.node_id),
la AS (SELECT n.repo_id, n.node_id, coalesce(max(ly.d), -1) AS layer FROM (SELECT DISTINCT repo_id, node_id FROM nodes) n LEFT JOIN ly USING (repo_id, node_id) GROUP BY ALL)"""
ORACLE_SQL["g11_topo_layers"] = stated(f"WITH RECURSIVE {_layers} SELECT repo_id, node_id, layer FROM la")
ORACLE_SQL["g12_longest_path_rank"] = stated(f"""WITH RECURSIVE {_layers}, gv AS (SELECT e.repo_id, e.dst AS node_id, max(la.layer) + 1 AS r FROM edges e JOIN la ON la.repo_id = e.repo_id AND la.node_id = e.src WHERE la.layer >= 0 GROUP BY ALL)
SELECT la.repo_id, la.node_id, CASE WHEN layer >= 0 THEN layer ELSE coalesce(gv.r, 0) END AS rank FROM la LEFT JOIN gv USING (repo_id, node_id)""")
ORACLE_SQL["g14_dag_share"] = stated(f"WITH RECURSIVE {_around}, c AS (SELECT repo_id, count(*) AS n FROM bk GROUP BY ALL) SELECT x.repo_id, round(1 - coalesce(c.n, 0) / x.nodes, 6) AS share FROM (SELECT repo_id, count(*) AS nodes FROM nodes GROUP BY ALL) x LEFT JOIN c USING (repo_id)")


# --- file trees ---------------------------------------------------------------------------------------------


def _tree(files: DataFrame) -> DataFrame:
    """The files written as a tree, a folder for each repository, and read back as it is found there."""
    spark, folder = files.sparkSession, f"{shared_folder(files.sparkSession)}/trees/{uuid4().hex}"
    once = files.groupBy("repo_id", "path").agg(F.min("source").alias("source"))
    write_modules(once.withColumn("source", F.when(F.endswith("source", F.lit("\n")), F.col("source")).otherwise(F.concat("source", F.lit("\n")))), folder)
    return read_modules(spark, folder)


register("a1_read_modules", "modules", _tree, "SELECT repo_id, path, CASE WHEN ends_with(min(source), chr(10)) THEN min(source) ELSE min(source) || chr(10) END AS source, CAST(NULL AS VARCHAR) AS problem FROM modules GROUP BY repo_id, path")
