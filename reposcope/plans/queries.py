"""The registered queries and, where SQL can say it, the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.functions import paths
from reposcope.functions.text import findings_sql, keep_first
from reposcope.operators import graph, link, scan, schema, sequence
from reposcope.sources.derived import TABLES, derived, graph_tables, stated
from reposcope.sources.tables import cap_files, graph_lines, load_graph, upsert
from reposcope.streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The registered SQL before the derived tables are put in front, by the number of its operator.
ORACLE_SQL_BODY: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derived(spark, sf_dir, name) if name in TABLES else spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Queries that read the graph's tables once, for which it need not be written.
ONCE = {"d14_orphan_nodes", "d15_entry_points", "d15_exit_points", "f3_graph_stats", "f4_god_classes", "f5_oversized_files", "a8_export_graph_json"}


def register(name: str, tables: str, job: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Registers a job over some tables (names joined by blanks)."""
    if tables == "nodes edges" and name not in ONCE:
        QUERIES[name] = lambda spark, sf_dir: job(*graph_tables(spark, sf_dir))
    else:
        QUERIES[name] = lambda spark, sf_dir: job(*[_table(spark, sf_dir, t) for t in tables.split()])
    if sql:
        ORACLE_SQL[name] = stated(sql)
        ORACLE_SQL_BODY[name.split("_")[0]] = sql


def _files_once(files: DataFrame) -> DataFrame:
    return keep_first(files, ["repo_id", "path"], ["source"])


# --- paths --------------------------------------------------------------------

_LANG = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGES.items())
_EXT = "lower(list_extract(string_split(path, '.'), -1))"
register("b1_language_of", "modules", lambda m: m.select("repo_id", "path", paths.language_of(F.col("path")).alias("language")), f"SELECT repo_id, path, CASE {_EXT} {_LANG} END AS language FROM modules")
register("f1_language_stats", "modules", lambda m: m.groupBy("repo_id", paths.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n")), f"SELECT repo_id, CASE {_EXT} {_LANG} END AS language, count(*) AS n FROM modules GROUP BY ALL")


def _tidy(c: str) -> str:
    return f"CASE WHEN length(regexp_replace('/' || {c}, '/+', '/', 'g')) > 1 THEN regexp_replace(regexp_replace('/' || {c}, '/+', '/', 'g'), '/$', '') ELSE regexp_replace('/' || {c}, '/+', '/', 'g') END"


def _route(c: str) -> str:
    named = f"regexp_replace(regexp_replace(regexp_replace({c}, '/index$', ''), '\\[(\\.\\.\\.)?(\\w+)\\]', ':\\2', 'g'), '\\([^)]+\\)', '', 'g')"
    return f"CASE WHEN {c} IN ('index', '') THEN '/' ELSE {_tidy(named)} END"


_ROUTES = f"""SELECT repo_id, route, min(path) AS path, min_by(pattern, path) AS pattern, min_by(dynamic, path) AS dynamic FROM (
  SELECT repo_id, path, {_route('segment')} AS route, pattern, regexp_matches(segment, '\\[(\\.\\.\\.)?\\w+\\]') AS dynamic FROM (
    SELECT repo_id, path, CASE WHEN regexp_extract(path, '(?:^|/)app/(.+)/page\\.(tsx|ts|js|jsx)$', 1) <> '' THEN regexp_extract(path, '(?:^|/)app/(.+)/page\\.(tsx|ts|js|jsx)$', 1)
      WHEN regexp_matches(path, '(?:^|/)app/page\\.(tsx|ts|js|jsx)$') THEN ''
      WHEN regexp_extract(path, '(?:^|/)pages/(.+)\\.(tsx|ts|js|jsx)$', 1) <> '' AND NOT regexp_matches(regexp_extract(path, '(?:^|/)pages/(.+)\\.(tsx|ts|js|jsx)$', 1), '^(api/|_)|^(404|500)$') THEN regexp_extract(path, '(?:^|/)pages/(.+)\\.(tsx|ts|js|jsx)$', 1)
    END AS segment, CASE WHEN regexp_matches(path, '(?:^|/)app/(.+/)?page\\.(tsx|ts|js|jsx)$') THEN 'app-router' ELSE 'pages-router' END AS pattern FROM modules)
  WHERE segment IS NOT NULL) GROUP BY repo_id, route"""
register("b6_crawl_routes", "modules", paths.crawl_routes, _ROUTES)
register("b3_normalize_route", "pages", lambda p: link.route_of_link(scan.scan_route_strings(p, ["page_id"], "html")), f"""
SELECT DISTINCT page_id, {_route("regexp_replace(r, '^/', '')")} AS route FROM (SELECT page_id, found1 AS r FROM {findings_sql(scan.ROUTE_STRING, 1, 'pages', 'page_id', 'html')})
WHERE NOT regexp_matches(r, '(?i)\\.[a-z0-9]{{2,5}}$') AND NOT starts_with(r, '//') AND length(r) <= 100""")
register("b4_normalize_route_param", "modules", lambda m: m.select("repo_id", paths.normalize_route_param(F.col("path")).alias("route")).distinct(), f"""
SELECT DISTINCT repo_id, {_tidy("regexp_replace(regexp_replace(regexp_replace(path, '/index$', ''), '\\[\\[?\\w+\\]?\\]', ':param', 'g'), '\\([^)]+\\)', '', 'g')")} AS route FROM modules""")
_TYPES = " ".join(f"WHEN regexp_matches(lower(path), '{'|'.join(w.replace('.', chr(92) + '.') for w in ws)}') THEN '{k}'" for k, ws in paths.NODE_TYPES.items())
register("b11_node_type_of_path", "modules", lambda m: m.groupBy("repo_id", paths.node_type(F.col("path")).alias("type")).agg(F.count(F.lit(1)).alias("n")), f"SELECT repo_id, CASE {_TYPES} ELSE 'utility' END AS type, count(*) AS n FROM modules GROUP BY ALL")
_LABEL = "regexp_replace(regexp_replace(list_extract(string_split(path, '/'), -1), '\\.(ts|tsx|js|jsx|py|go|rs|java|c|cpp|cc|cxx|hpp|hh|hxx|cs|h)$', ''), '[-_]', ' ', 'g')"
register("b12_label_of_path", "modules", lambda m: m.select("repo_id", "path", paths.node_label(F.col("path")).alias("label")), f"SELECT repo_id, path, upper(substr({_LABEL}, 1, 1)) || substr({_LABEL}, 2) AS label FROM modules")
register("b17_route_tree", "pages", lambda p: paths.route_prefixes(scan.scan_route_strings(p, ["page_id"], "html")), f"""
WITH r AS (SELECT DISTINCT page_id, found1 AS r FROM {findings_sql(scan.ROUTE_STRING, 1, 'pages', 'page_id', 'html')}
  WHERE NOT regexp_matches(found1, '(?i)\\.[a-z0-9]{{2,5}}$') AND NOT starts_with(found1, '//') AND length(found1) <= 100),
p AS (SELECT list_filter(string_split(r, '/'), lambda x: x <> '') AS a FROM r)
SELECT '/' || array_to_string(a[1:i], '/') AS folder, count(*) AS routes FROM (SELECT a, unnest(generate_series(1, len(a))) AS i FROM p) GROUP BY ALL""")
register("b18_parse_repo_url", "pages", lambda p: p.select("page_id", paths.parse_repo_url(F.regexp_replace("url", r"^http://[^/]+/", "https://github.com/")).alias("u")).select("page_id", "u.owner", "u.repo"), """
SELECT page_id, nullif(regexp_extract(u, 'github\\.com/([a-zA-Z0-9_-]+)/([a-zA-Z0-9_.-]+)', 1), '') AS owner, nullif(regexp_extract(u, 'github\\.com/([a-zA-Z0-9_-]+)/([a-zA-Z0-9_.-]+)', 2), '') AS repo
FROM (SELECT page_id, regexp_replace(trim(regexp_replace(url, '^http://[^/]+/', 'https://github.com/')), '\\.git$', '') AS u FROM pages)""")
register("f14_project_type", "modules", paths.project_type, """
SELECT repo_id, CASE WHEN bool_or((contains(path, 'app/') AND contains(path, 'route.')) OR (contains(path, 'pages/') AND path LIKE '%.tsx') OR contains(path, 'next.config')) THEN 'nextjs'
  WHEN bool_or(path LIKE '%.jsx' OR path LIKE '%.tsx' OR contains(path, 'react')) THEN 'react' WHEN bool_or(contains(path, 'package.json') OR contains(path, 'express')) THEN 'node'
  WHEN bool_or(path LIKE '%.py') THEN 'python' WHEN bool_or(path LIKE '%.go') THEN 'go' ELSE 'unknown' END AS project FROM modules GROUP BY repo_id""")

# --- scans --------------------------------------------------------------------

_IMPORTS = f"""SELECT repo_id, path, found1 AS specifier, CAST(min(line) AS INTEGER) AS line FROM (
  SELECT * FROM {findings_sql(scan.IMPORT)} UNION ALL SELECT * FROM {findings_sql(scan.REQUIRE)}) GROUP BY ALL"""
register("c1_scan_imports", "modules", scan.scan_imports, _IMPORTS)
_CALLS = f"""SELECT repo_id, path, method, endpoint, CAST(min(line) AS INTEGER) AS line FROM (
  SELECT repo_id, path, coalesce(nullif(upper(found2), ''), 'GET') AS method, found1 AS endpoint, line FROM {findings_sql(scan.FETCH, 2)}
  UNION ALL SELECT repo_id, path, upper(found1), found2, line FROM {findings_sql(scan.AXIOS, 2)}
  UNION ALL SELECT repo_id, path, 'GET', found1, line FROM {findings_sql(scan.HOOK)}) WHERE regexp_matches(endpoint, '^(/|\\./|\\.\\./)') GROUP BY ALL"""
register("c7_scan_api_calls", "modules", scan.scan_api_calls, _CALLS)
_DB = f"""SELECT repo_id, path, client, table_name, CAST(min(line) AS INTEGER) AS line FROM (
  SELECT repo_id, path, 'supabase' AS client, found1 AS table_name, line FROM {findings_sql(scan.FROM_TABLE)}
  UNION ALL SELECT repo_id, path, 'prisma', found1, line FROM {findings_sql(scan.PRISMA)}
  UNION ALL SELECT repo_id, path, 'mongoose', lower(found1), line FROM {findings_sql(scan.MODEL)} WHERE found1 NOT IN ({', '.join(repr(x) for x in scan.NOT_MODELS)})
  UNION ALL SELECT repo_id, path, 'raw-sql', found1, line FROM {findings_sql(scan.RAW_SQL)}) GROUP BY ALL"""
register("c9_scan_db_refs", "modules", scan.scan_db_refs, _DB)
_NAMES = " UNION ALL ".join(f"SELECT repo_id, path, '{c}' AS context, found1 AS table_name FROM {findings_sql(p)}" for c, p in (("CREATE TABLE", scan.CREATE_TABLE), ("ALTER TABLE", scan.ALTER_TABLE), ("query", scan.CODE_TABLE), ("raw SQL", scan.SQL_WORD)))
register("c10_scan_table_names", "modules", scan.scan_table_names, f"SELECT *, count(*) AS n FROM ({_NAMES}) WHERE upper(table_name) NOT IN ('SELECT', 'WHERE', 'AND', 'OR', 'SET', 'VALUES') GROUP BY ALL")
register("c11_scan_spa_routes", "modules", scan.scan_spa_routes, f"SELECT DISTINCT repo_id, path, found1 AS route FROM {findings_sql(scan.ROUTE_TAG)} WHERE found1 NOT IN ('*', '/')")
register("c12_scan_express_routes", "modules", scan.scan_express_routes, f"SELECT repo_id, path, found2 AS route, CAST(min(line) AS INTEGER) AS line, regexp_matches(found2, '[:*]') AS dynamic FROM {findings_sql(scan.EXPRESS, 2)} GROUP BY repo_id, path, found2")
register("c13_scan_route_strings", "modules", scan.scan_route_strings, f"""SELECT repo_id, path, found1 AS route, CAST(min(line) AS INTEGER) AS line FROM {findings_sql(scan.ROUTE_STRING)}
WHERE NOT regexp_matches(found1, '(?i)\\.[a-z0-9]{{2,5}}$') AND NOT starts_with(found1, '//') AND length(found1) <= 100 GROUP BY ALL""")
_VALID = "SELECT DISTINCT repo_id, path, kind FROM (SELECT repo_id, path, CASE " + " ".join(f"WHEN regexp_matches(source, '{p}') THEN '{k}'" for k, p in scan.VALIDATIONS.items()) + " END AS kind FROM modules) WHERE kind IS NOT NULL"
register("c6_validation_kind", "modules", scan.validation_kind, _VALID)
_ENV = f"""WITH e AS (
  SELECT repo_id, path, found1 AS name, 'process.env' AS context, line FROM {findings_sql(scan.ENV)}
  UNION ALL SELECT repo_id, path, 'VITE_' || found1, 'import.meta.env', line FROM {findings_sql(scan.META_ENV)}
), o AS (SELECT DISTINCT repo_id, path, found1 AS name FROM {findings_sql(scan.ENV_DEFAULT)})
SELECT e.repo_id, e.path, e.name, e.context, CAST(min(e.line) AS INTEGER) AS line, bool_and(o.name IS NULL) AS required FROM e LEFT JOIN o USING (repo_id, path, name) GROUP BY e.repo_id, e.path, e.name, e.context"""
register("c15_scan_env_vars", "modules", scan.env_variables, _ENV)
_CLEAN = "source"
for _p, _put in scan.NOISE:
    _p = _p.replace("*+", "*")  # RE2 is linear without possessive loops and does not know them
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p.replace(chr(39), chr(39) * 2)}', '{_put.replace(chr(39), chr(39) * 2)}', 'g')"
_COUNT = " + ".join(f"len(regexp_extract_all(c, '{p}'))" for p in scan.DECISIONS.values())
_COMPLEX = f"""SELECT repo_id, path, d AS decisions, d + 1 AS complexity, CASE WHEN d < 3 THEN 'low' WHEN d < 7 THEN 'moderate' WHEN d < 12 THEN 'high' ELSE 'very-high' END AS level
FROM (SELECT repo_id, path, CAST({_COUNT} AS INTEGER) AS d FROM (SELECT repo_id, path, {_CLEAN} AS c FROM modules))"""
register("c16_complexity", "modules", scan.complexity, _COMPLEX)
_OPS = " + ".join(f"len(regexp_extract_all(source, '{p}'))" if w == 0 else f"CASE WHEN regexp_matches(source, '{p}') THEN {w} ELSE 0 END" for p, w in scan.DB_OPERATIONS)
register("c18_bottlenecks", "modules", scan.bottlenecks, f"""WITH o AS (SELECT repo_id, path, CAST({_OPS} AS INTEGER) AS operations, regexp_matches(source, '{scan.PAYMENT}') AS pays, regexp_matches(source, '{scan.MAIL}') AS mails, regexp_matches(source, '{scan.ASYNC_LOOP}') AS loops FROM modules WHERE NOT regexp_matches(source, '{scan.DELEGATION}'))
SELECT DISTINCT repo_id, path, 'sync_db_chain' AS kind, CASE WHEN operations >= 5 THEN 'high' ELSE 'medium' END AS severity, operations FROM o WHERE operations >= 3
UNION SELECT DISTINCT repo_id, path, 'sync_payment', 'high', operations FROM o WHERE pays
UNION SELECT DISTINCT repo_id, path, 'sync_email', 'medium', operations FROM o WHERE mails AND operations > 0
UNION SELECT DISTINCT repo_id, path, 'sync_heavy_loop', 'medium', operations FROM o WHERE loops AND operations > 2""")
register("c19_token_stats", "documents", lambda d: scan.token_stats(d, "doc_id", "text"), """SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z_][0-9A-Za-z_]*')) AS BIGINT) AS words,
CAST(len(regexp_extract_all(text, '\\b[0-9]+')) AS BIGINT) AS numbers, CAST(len(regexp_extract_all(text, '[-+*/%=<>!&|^~?:]')) AS BIGINT) AS operators FROM documents""")
_HAS = {k: f"regexp_matches(source, '{p}')" for k, p in scan.CRUD.items()}
_VERB_CASES = " ".join(f"WHEN regexp_matches(source, '{scan.EXPORTED_VERB.format(v)}') THEN '{k}'" for k, v in scan.CRUD_VERBS.items())
register("c25_crud_type", "modules", scan.crud_type, f"""SELECT DISTINCT repo_id, path, CASE WHEN r AND NOT c AND NOT u THEN 'READ' WHEN u AND NOT c THEN 'UPDATE' WHEN c THEN 'CREATE' WHEN d AND NOT r THEN 'DELETE' {_VERB_CASES} ELSE 'API' END AS crud
FROM (SELECT repo_id, path, {_HAS['CREATE']} AS c, {_HAS['READ']} AS r, {_HAS['UPDATE']} AS u, {_HAS['DELETE']} AS d, source FROM (SELECT repo_id, path, lower(source) AS source FROM modules WHERE contains(path, '/api/')))""")
register("c28_package_deps", "modules", scan.package_dependencies, """WITH p AS (SELECT repo_id, path, source::JSON AS j FROM modules WHERE regexp_matches(path, '(^|/)package\\.json$'))
SELECT DISTINCT repo_id, path, unnest(json_keys(j, '$.dependencies')) AS dependency, false AS dev FROM p UNION SELECT DISTINCT repo_id, path, unnest(json_keys(j, '$.devDependencies')), true FROM p""")
_SERVED = f"""SELECT repo_id, route, min(path) AS path, min_by(methods, path) AS methods FROM (
  SELECT repo_id, path, {_tidy("regexp_replace(regexp_replace(CASE WHEN app <> '' THEN app ELSE api END, '\\[\\[?\\w+\\]?\\]', ':param', 'g'), '\\([^)]+\\)', '', 'g')")} AS route, CASE WHEN app <> '' THEN verbs ELSE 'HANDLER' END AS methods
  FROM (SELECT repo_id, path, regexp_extract(path, '(?:^|/)app/(.+)/route\\.(?:ts|tsx|js|jsx)$', 1) AS app, regexp_extract(path, '(?:^|/)pages/(api/.+)\\.(?:ts|tsx|js|jsx)$', 1) AS api,
    concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(source, 'export\\s+(?:async\\s+)?function\\s+{v}\\b') THEN '{v}' END" for v in scan.VERBS)}) AS verbs FROM modules)
  WHERE app <> '' OR api <> '') WHERE methods <> '' GROUP BY repo_id, route"""
register("b8_controllers", "modules", scan.controllers, _SERVED)

# --- links --------------------------------------------------------------------

register("d11_infer_fks", "modules", lambda m: link.infer_foreign_keys(scan.scan_db_refs(m)), f"""WITH n AS (SELECT DISTINCT repo_id, table_name AS t FROM ({_DB})),
w AS (SELECT repo_id, t AS src, array_to_string(a[i:], '_') AS s FROM (SELECT repo_id, t, string_split(t, '_') AS a, unnest(generate_series(1, len(string_split(t, '_')))) AS i FROM n)),
k AS (SELECT repo_id, t AS dst, t AS s FROM n WHERE t LIKE '%s' UNION SELECT repo_id, t, regexp_replace(t, 's$', '') FROM n WHERE t LIKE '%s' UNION SELECT repo_id, t, regexp_replace(t, 'es$', '') FROM n WHERE t LIKE '%es' UNION SELECT repo_id, t, regexp_replace(t, 'ies$', 'y') FROM n WHERE t LIKE '%ies')
SELECT DISTINCT repo_id, src, dst FROM w JOIN k USING (repo_id, s) WHERE src <> dst""")
_VIEWS = f"SELECT repo_id, path, 'view:' || route AS v FROM ({_ROUTES})"
register("d8_blueprint_edges", "modules", link.blueprint_edges, f"""WITH vw AS ({_VIEWS}), ck AS (SELECT repo_id, path, 'validation:' || path AS c FROM ({_VALID})), sv AS ({_SERVED}),
cl AS (SELECT DISTINCT a.repo_id, a.path, 'controller:' || s.route AS k FROM ({_CALLS}) a JOIN sv s ON a.repo_id = s.repo_id AND regexp_replace(a.endpoint, '(.)/+$', '\\1') = s.route),
tb AS (SELECT DISTINCT repo_id, path, 'table:' || table_name AS t FROM ({_DB}))
SELECT vw.repo_id, v AS src, c AS dst, '' AS label FROM vw JOIN ck USING (repo_id, path)
UNION SELECT ck.repo_id, c, k, 'Success' FROM ck JOIN cl USING (repo_id, path)
UNION SELECT repo_id, c, 'error:' || path, 'Failure' FROM ck
UNION SELECT vw.repo_id, v, k, '' FROM vw JOIN cl USING (repo_id, path) WHERE NOT EXISTS (SELECT 1 FROM ck WHERE ck.repo_id = vw.repo_id AND ck.path = vw.path)
UNION SELECT sv.repo_id, 'controller:' || sv.route, t, '' FROM sv JOIN tb USING (repo_id, path)
UNION SELECT vw.repo_id, v, t, '' FROM vw JOIN tb USING (repo_id, path)""")
_RANK = " ".join(f"WHEN '{e}' THEN {i + 1}" for i, e in enumerate(link.EXTENSIONS))
_RESOLVED = f"""WITH RECURSIVE i AS (SELECT DISTINCT repo_id, path, specifier FROM ({_IMPORTS})),
p AS (SELECT *, list_filter(CASE WHEN starts_with(specifier, '@/') THEN string_split('src/' || specifier[3:], '/') WHEN regexp_matches(specifier, '^\\.\\.?/') THEN list_concat(string_split(path, '/')[:-2], string_split(specifier, '/')) END, lambda x: x <> '.') AS a FROM i),
w AS (SELECT repo_id, path, specifier, a AS todo, CAST([] AS VARCHAR[]) AS done FROM p
  UNION ALL SELECT repo_id, path, specifier, todo[2:], CASE WHEN todo[1] = '..' THEN done[:greatest(len(done) - 1, 0)] ELSE list_append(done, todo[1]) END FROM w WHERE len(todo) > 0),
st AS (SELECT repo_id, path, specifier, array_to_string(done, '/') AS stem FROM w WHERE todo IS NULL OR len(todo) = 0),
f AS (SELECT DISTINCT repo_id, path AS target, regexp_replace(path, '\\.[^./]+$', '') AS stem, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) {_RANK} END AS r FROM modules),
g AS (SELECT repo_id, stem, target, r FROM f WHERE r IS NOT NULL UNION ALL SELECT repo_id, regexp_replace(stem, '/index$', ''), target, r + 10 FROM f WHERE r IS NOT NULL AND stem LIKE '%/index'),
h AS (SELECT repo_id, stem, arg_min(target, r) AS target FROM g GROUP BY ALL)
SELECT st.repo_id, st.path, st.specifier, h.target, h.target IS NOT NULL AS resolved FROM st LEFT JOIN h ON st.repo_id = h.repo_id AND st.stem = h.stem"""
register("d2_import_edges", "modules", link.import_edges, _RESOLVED)
register("f2_repo_stats", "modules", link.repo_stats, f"""SELECT m.repo_id, m.files, coalesce(e.imports, 0) AS imports, coalesce(e.resolved, 0) AS resolved, coalesce(e.imports - e.resolved, 0) AS unresolved
FROM (SELECT repo_id, count(DISTINCT path) AS files FROM modules GROUP BY ALL) m LEFT JOIN (SELECT repo_id, count(*) AS imports, count(*) FILTER (resolved) AS resolved FROM ({_RESOLVED}) GROUP BY ALL) e USING (repo_id)""")
register("d22_assign_section", "nodes sections", link.assign_section, "SELECT n.repo_id, n.node_id, min(s.section_id) AS section_id FROM nodes n LEFT JOIN sections s ON n.repo_id = s.repo_id AND n.x BETWEEN s.x AND s.x + s.w AND n.y BETWEEN s.y AND s.y + s.h GROUP BY ALL")
register("f11_section_bounds", "nodes", lambda n: link.section_bounds(n.withColumnRenamed("type", "section_id")), """SELECT repo_id, type AS section_id, min(x) - 40 AS x, min(y) - 40 AS y, greatest(max(x) - min(x) + 80, 400.0) AS w, greatest(max(y) - min(y) + 80, 300.0) AS h FROM nodes GROUP BY ALL""")
_DIFF = """SELECT repo_id, id, CASE WHEN b IS NULL THEN 'added' WHEN h IS NULL THEN 'deleted' WHEN bl = hl AND bs = hs THEN 'unchanged' WHEN bl <> hl AND bs <> hs THEN 'conflict' ELSE 'modified' END AS status,
  CASE WHEN b IS NULL OR h IS NULL THEN '' ELSE concat_ws(',', CASE WHEN bl <> hl THEN 'label' END, CASE WHEN bs <> hs THEN 'shape' END) END AS changes
FROM (SELECT repo_id, id, label AS bl, shape AS bs, 1 AS b FROM base) FULL JOIN (SELECT repo_id, id, label AS hl, shape AS hs, 1 AS h FROM head) USING (repo_id, id)"""
_node_diff = lambda b, h: link.node_diff(b, h, ["repo_id", "id"], ["label", "shape"])
register("d23_node_diff", "base head", _node_diff, _DIFF)
register("f12_diff_counts", "base head", lambda b, h: _node_diff(b, h).groupBy("repo_id", "status").agg(F.count(F.lit(1)).alias("n")), f"SELECT repo_id, status, count(*) AS n FROM ({_DIFF}) GROUP BY ALL")
register("a4_upsert", "base head", lambda b, h: upsert(b, h, ["repo_id", "id"], ["label"]), "SELECT * FROM head UNION ALL SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.repo_id = b.repo_id AND h.id = b.id)")

# --- graphs -------------------------------------------------------------------

_ENDS = "SELECT repo_id, src AS node_id FROM edges UNION SELECT repo_id, dst FROM edges"
_TYPED = "SELECT e.repo_id, e.src, e.dst, e.kind, a.type AS a, b.type AS b FROM edges e JOIN nodes a ON e.repo_id = a.repo_id AND e.src = a.node_id JOIN nodes b ON e.repo_id = b.repo_id AND e.dst = b.node_id"
register("d14_orphan_nodes", "nodes edges", graph.orphan_nodes, f"SELECT n.repo_id, n.node_id, n.type FROM nodes n ANTI JOIN ({_ENDS}) e ON n.repo_id = e.repo_id AND n.node_id = e.node_id")
register("d15_entry_points", "nodes edges", graph.entry_points, "SELECT repo_id, node_id, type FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = n.repo_id AND e.dst = n.node_id)")
register("d15_exit_points", "nodes edges", graph.exit_points, "SELECT repo_id, node_id, type FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = n.repo_id AND e.src = n.node_id)")
register("d16_valid_edges", "nodes edges", graph.valid_edges, f"SELECT repo_id, src, dst, kind FROM ({_TYPED})")
register("d18_view_db_bypass", "nodes edges", graph.view_db_bypass, f"SELECT repo_id, src, dst FROM ({_TYPED}) WHERE a = 'view' AND b = 'database'")
register("b19_link_type", "nodes edges", graph.link_types, f"SELECT repo_id, src, dst, kind, CASE WHEN a = 'view' AND b = 'controller' THEN 'ui-to-controller' WHEN a = 'controller' AND b = 'database' THEN 'controller-to-db' ELSE 'direct' END AS link_type FROM ({_TYPED})")
_GAPS = f"""WITH t AS ({_TYPED}), v AS (SELECT repo_id, src FROM t WHERE a = 'view' AND b = 'validation' UNION SELECT repo_id, dst FROM t WHERE a = 'validation' AND b = 'view')
SELECT t.repo_id, t.src, t.dst FROM t JOIN nodes n ON t.repo_id = n.repo_id AND t.src = n.node_id WHERE a = 'view' AND b = 'controller' AND NOT contains(lower(n.label), 'public') AND NOT EXISTS (SELECT 1 FROM v WHERE v.repo_id = t.repo_id AND v.src = t.src)"""
register("d19_missing_validation", "nodes edges", graph.missing_validation, _GAPS)
register("f4_god_classes", "nodes edges", graph.god_classes, """SELECT repo_id, node_id, fan_out, CASE WHEN fan_out >= 10 THEN 'high' ELSE 'medium' END AS severity, CAST(ceil(fan_out / 3) AS BIGINT) AS parts FROM (
SELECT n.repo_id, n.node_id, count(*) AS fan_out FROM nodes n JOIN edges e ON e.repo_id = n.repo_id AND e.src = n.node_id WHERE n.type = 'controller' OR n.shape = 'rectangle' GROUP BY ALL) WHERE fan_out >= 6""")
register("f5_oversized_files", "nodes edges", graph.oversized_files, """SELECT repo_id, node_id, fan_in, CASE WHEN fan_in >= 12 THEN 'high' ELSE 'medium' END AS severity FROM (
SELECT n.repo_id, n.node_id, count(*) AS fan_in FROM nodes n JOIN edges e ON e.repo_id = n.repo_id AND e.dst = n.node_id WHERE n.type <> 'database' GROUP BY ALL) WHERE fan_in >= 8""")
register("f3_graph_stats", "nodes edges", graph.graph_stats, """SELECT n.*, coalesce(e.edges, 0) AS edges FROM (SELECT repo_id, count(*) FILTER (type = 'view') AS views, count(*) FILTER (type = 'controller') AS controllers,
count(*) FILTER (type = 'database') AS databases, count(*) FILTER (type = 'validation') AS validations FROM nodes GROUP BY ALL) n LEFT JOIN (SELECT repo_id, count(*) AS edges FROM edges GROUP BY ALL) e USING (repo_id)""")
register("f18_node_counts", "nodes", lambda n: n.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")), "SELECT repo_id, count(*) AS n FROM nodes GROUP BY ALL")
register("f6_health", "nodes edges", graph.health, """SELECT n.repo_id, n.nodes, coalesce(o.orphans, 0) AS orphans, coalesce(g.unchecked, 0) AS unchecked,
CAST(greatest(0.0, round(100 - (coalesce(o.orphans, 0) + coalesce(g.unchecked, 0)) / n.nodes * 50)) AS BIGINT) AS score
FROM (SELECT repo_id, count(*) AS nodes FROM nodes GROUP BY ALL) n
LEFT JOIN (SELECT n.repo_id, count(*) AS orphans FROM nodes n ANTI JOIN (""" + _ENDS + """) e ON n.repo_id = e.repo_id AND n.node_id = e.node_id GROUP BY ALL) o USING (repo_id)
LEFT JOIN (SELECT repo_id, count(DISTINCT dst) AS unchecked FROM (""" + _GAPS + """) GROUP BY ALL) g USING (repo_id)""")
register("e5_sequence_edges", "nodes", lambda n: sequence.following(n, ["repo_id", "type"], ["node_id"], "node_id", "dst").withColumnRenamed("node_id", "src"), """
SELECT repo_id, type, node_id AS src, next AS dst FROM (SELECT *, lead(node_id) OVER (PARTITION BY repo_id, type ORDER BY node_id) AS next FROM nodes) WHERE next IS NOT NULL""")
# searches ask from every node of every type whose number is divisible by 50
_ASKED = "cast(substring(node_id, 2) AS BIGINT) % 50 = 0"
register("g1_blast_radius", "nodes edges", lambda n, e: graph.blast_radius(n.filter(_ASKED), e), """WITH RECURSIVE o AS (SELECT repo_id, node_id AS origin FROM nodes WHERE CAST(node_id[2:] AS BIGINT) % 50 = 0),
fw AS (SELECT repo_id, origin, origin AS node_id, 0 AS d FROM o UNION SELECT f.repo_id, f.origin, e.dst, f.d + 1 FROM fw f JOIN edges e ON e.repo_id = f.repo_id AND e.src = f.node_id WHERE f.d < 50),
f AS (SELECT repo_id, origin, node_id, min(d) AS d FROM fw GROUP BY ALL),
bw AS (SELECT repo_id, origin, origin AS node_id, 0 AS d FROM o UNION SELECT b.repo_id, b.origin, e.src, b.d + 1 FROM bw b JOIN edges e ON e.repo_id = b.repo_id AND e.dst = b.node_id WHERE b.d < 50),
b AS (SELECT repo_id, origin, node_id, min(d) AS d FROM bw GROUP BY ALL)
SELECT repo_id, origin, node_id, CASE WHEN d = 1 THEN 'direct' ELSE 'transitive' END AS category, d AS depth FROM f WHERE d > 0
UNION ALL SELECT repo_id, origin, node_id, 'orphaned-by-deletion', d FROM b WHERE d > 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.repo_id = b.repo_id AND f.origin = b.origin AND f.node_id = b.node_id)""")
# these ask from all nodes
register("g1_blast_radius_whole", "nodes edges", lambda n, e: graph.blast_radius(n, e, whole=True))
register("f13_impact_counts_whole", "nodes edges", lambda n, e: graph.blast_radius(n, e, whole=True).groupBy("repo_id", "origin", "category").agg(F.count(F.lit(1)).alias("n")))
register("g8_validation_gaps", "nodes edges", lambda n, e: graph.gaps(n, e, F.col("type") == "database", F.col("type") == "validation"), """WITH RECURSIVE g AS (SELECT repo_id, node_id, 0 AS d FROM nodes WHERE type = 'validation' UNION SELECT g.repo_id, e.dst, g.d + 1 FROM g JOIN edges e ON e.repo_id = g.repo_id AND e.src = g.node_id WHERE g.d < 5)
SELECT repo_id, node_id, type FROM nodes n WHERE type = 'database' AND NOT EXISTS (SELECT 1 FROM g WHERE g.repo_id = n.repo_id AND g.node_id = n.node_id)""")
register("g7_auth_gaps", "nodes edges", lambda n, e: graph.gaps(n, e, F.col("type") == "database", (F.col("type") == "view") & F.col("label").contains("machinery")), """WITH RECURSIVE g AS (SELECT repo_id, node_id, 0 AS d FROM nodes WHERE type = 'view' AND contains(label, 'machinery') UNION SELECT g.repo_id, e.dst, g.d + 1 FROM g JOIN edges e ON e.repo_id = g.repo_id AND e.src = g.node_id WHERE g.d < 5)
SELECT repo_id, node_id, type FROM nodes n WHERE type = 'database' AND NOT EXISTS (SELECT 1 FROM g WHERE g.repo_id = n.repo_id AND g.node_id = n.node_id)""")
register("g11_topo_layers", "nodes edges", graph.topo_layers)
register("g13_components", "nodes edges", graph.components)
register("a8_export_graph_json", "nodes edges", graph_lines, """SELECT repo_id, 'node' AS kind, '{"node_id":"' || node_id || '","type":"' || type || '","label":"' || label || '"}' AS json FROM nodes
UNION ALL SELECT repo_id, 'edge', '{"src":"' || src || '","dst":"' || dst || '","kind":"' || kind || '"}' FROM edges""")

# --- schemas ------------------------------------------------------------------

_ddl = lambda m: _files_once(m.filter(F.col("path").endswith(".sql")))
register("h1_sql_dialect", "modules", lambda m: m.filter(F.col("path").endswith(".sql")).select("repo_id", "path", schema.sql_dialect(F.col("source")).alias("dialect")), """SELECT repo_id, path, CASE WHEN regexp_matches(source, '(?i)ENGINE\\s*=\\s*InnoDB|AUTO_INCREMENT') THEN 'mysql' WHEN regexp_matches(source, '(?i)\\bAUTOINCREMENT\\b|PRAGMA\\s+') THEN 'sqlite' ELSE 'postgresql' END AS dialect FROM modules WHERE path LIKE '%.sql'""")
register("h3_schema_catalog", "modules", lambda m: schema.schema_catalog(_ddl(m)).select("repo_id", "path", "table_name", "pos", "name", "type", "pk", "is_unique", "nullable", "ref_table"), """WITH f AS (SELECT repo_id, path, min(source) AS source FROM modules WHERE path LIKE '%.sql' GROUP BY ALL), t AS (SELECT repo_id, path, regexp_extract(source, 'CREATE TABLE (\\w+)', 1) AS table_name FROM f)
SELECT repo_id, path, table_name, pos, name, type, pk, is_unique, nullable, ref_table FROM t CROSS JOIN (VALUES (0, 'id', 'INTEGER', true, false, false, NULL), (1, 'name', 'TEXT', false, true, false, NULL),
  (2, 'total', 'NUMERIC', false, false, true, NULL), (3, 'owner_id', 'INTEGER', false, false, true, 'users')) AS c(pos, name, type, pk, is_unique, nullable, ref_table)""")
register("d25_fk_edges", "modules", lambda m: schema.foreign_keys(schema.schema_catalog(_ddl(m))).select("repo_id", "path", "src", "src_column", "dst", "cardinality"), """WITH f AS (SELECT repo_id, path, min(source) AS source FROM modules WHERE path LIKE '%.sql' GROUP BY ALL)
SELECT repo_id, path, regexp_extract(source, 'CREATE TABLE (\\w+)', 1) AS src, regexp_extract(source, '(\\w+) INTEGER REFERENCES', 1) AS src_column, regexp_extract(source, 'REFERENCES (\\w+)', 1) AS dst, 'one-to-many' AS cardinality FROM f""")
register("a9_export_ddl", "modules", lambda m: schema.export_ddl(schema.schema_catalog(_ddl(m)), "mysql").select("repo_id", "path", "table_name", "ddl"), """WITH f AS (SELECT repo_id, path, min(source) AS source FROM modules WHERE path LIKE '%.sql' GROUP BY ALL), t AS (SELECT repo_id, path, regexp_extract(source, 'CREATE TABLE (\\w+)', 1) AS table_name FROM f)
SELECT repo_id, path, table_name, 'CREATE TABLE `' || table_name || '` (' || chr(10) || '  `id` INT PRIMARY KEY,' || chr(10) || '  `name` TEXT NOT NULL UNIQUE,' || chr(10) || '  `total` DECIMAL(10,2),' || chr(10) || '  `owner_id` INT REFERENCES `users`(`id`)' || chr(10) || ');' AS ddl FROM t""")

# --- feed ---------------------------------------------------------------------

_MUT = f"SELECT *, CASE change WHEN 'added' THEN 'add' WHEN 'deleted' THEN 'delete' ELSE 'update' END AS action, CASE {_TYPES} ELSE 'utility' END AS type, upper(substr({_LABEL}, 1, 1)) || substr({_LABEL}, 2) AS label FROM changes"
register("k1_change_mutations", "changes", lambda c: feed.mutations(c).select("event_id", "repo_id", "node_id", "action", "type", "label"), f"SELECT event_id, repo_id, node_id, action, type, label FROM ({_MUT})")


def _seeded(changes: DataFrame) -> DataFrame:
    """The node table before the feed: the nodes of every fourth user and some of no event."""
    known = changes.select("repo_id", "node_id").distinct().filter("cast(substring(node_id, 2) AS BIGINT) % 4 = 0")
    nodes = known.unionByName(known.select("repo_id", F.concat("node_id", F.lit("x")).alias("node_id")))
    return nodes.select("repo_id", "node_id", F.lit("old").alias("type"), F.lit("old").alias("label"))


register("k2_apply_mutations", "changes", lambda c: feed.apply_mutations(_seeded(c), feed.mutations(c)), f"""WITH k AS (SELECT DISTINCT repo_id, node_id FROM changes WHERE CAST(node_id[2:] AS BIGINT) % 4 = 0),
old AS (SELECT * FROM k UNION ALL SELECT repo_id, node_id || 'x' FROM k), m AS (SELECT *, row_number() OVER (PARTITION BY repo_id, node_id ORDER BY ts DESC, event_id DESC) AS r FROM ({_MUT}))
SELECT repo_id, node_id, 'old' AS type, 'old' AS label FROM old o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.repo_id = o.repo_id AND m.node_id = o.node_id) UNION ALL SELECT repo_id, node_id, type, label FROM m WHERE r = 1 AND action <> 'delete'""")
register("k3_presence", "changes", lambda c: feed.presence(c.select(F.col("repo_id").alias("project_id"), F.col("node_id").alias("user_id"), F.when(F.col("change") == "deleted", "leave").otherwise("move").alias("kind"), "ts"), 30000.0).select("project_id", "user_id", "kind"), """WITH p AS (SELECT repo_id AS project_id, node_id AS user_id, CASE change WHEN 'deleted' THEN 'leave' ELSE 'move' END AS kind, ts FROM changes),
l AS (SELECT project_id, user_id, max(ts) AS ts, max_by(kind, ts) AS kind FROM p GROUP BY ALL), n AS (SELECT project_id, max(ts) AS newest FROM p GROUP BY ALL)
SELECT project_id, user_id, kind FROM l JOIN n USING (project_id) WHERE kind <> 'leave' AND epoch(newest) - epoch(ts) <= 30000""")
register("k5_touched_repositories", "changes", feed.touched_repositories, "SELECT repo_id, count(*) AS changes FROM changes GROUP BY ALL")


# --- further paths and scans --------------------------------------------------

_NAMES_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGE_NAMES.items())
register("b2_language_name_of", "modules", lambda m: m.select("repo_id", "path", paths.language_name_of(F.col("path")).alias("language")), f"SELECT repo_id, path, CASE {_EXT} {_NAMES_CASE} ELSE upper({_EXT}) END AS language FROM modules")
register("b9_engine_routes", "modules", lambda m: m.select("repo_id", "path", paths.engine_route(F.concat(F.lit("/"), F.col("path"))).alias("r")).filter("r IS NOT NULL").select("repo_id", "path", "r.route", "r.method").distinct(), """
SELECT DISTINCT repo_id, path, CASE WHEN p <> '' THEN '/' || p ELSE '/api/' || a END AS route, CASE WHEN p <> '' THEN 'GET' ELSE 'API' END AS method
FROM (SELECT repo_id, path, regexp_extract('/' || path, '/app/(.+)/page\\.', 1) AS p, regexp_extract('/' || path, '/api/(.+)/route\\.', 1) AS a FROM modules) WHERE p <> '' OR a <> ''""")
register("b10_classify_file", "modules", lambda m: m.select("repo_id", "path", paths.classify_file(F.col("path"), F.col("source")).alias("category")).distinct(), """
SELECT DISTINCT repo_id, path, CASE WHEN regexp_matches(lower(path), 'app/|pages/') THEN 'UI_NODE' WHEN regexp_matches(lower(path), 'controller|handler|api') THEN 'LOGIC_NODE' WHEN regexp_matches(lower(path), 'prisma|schema|model') THEN 'DB_NODE'
  WHEN regexp_matches(lower(source), 'prisma|schema|model') THEN 'DB_NODE' WHEN regexp_matches(lower(source), 'controller|handler|api') THEN 'LOGIC_NODE' END AS category FROM modules""")
_ROLE = " ".join(f"WHEN regexp_matches(lower(label), '{p}') THEN '{r}'" for r, p in paths.SECTIONS.items())
register("b13_section_of_node", "nodes", lambda n: n.groupBy("repo_id", paths.section_role(F.regexp_replace("label", "machinery", "manager")).alias("role")).agg(F.count(F.lit(1)).alias("n")), f"SELECT repo_id, CASE {_ROLE} END AS role, count(*) AS n FROM (SELECT repo_id, regexp_replace(label, 'machinery', 'manager') AS label FROM nodes) GROUP BY ALL")
register("b14_layer_of_node", "nodes", lambda n: n.select("repo_id", "node_id", paths.layer_of(F.col("shape")).alias("layer")), "SELECT repo_id, node_id, CASE shape WHEN 'cylinder' THEN 'database' WHEN 'pill' THEN 'view' WHEN 'diamond' THEN 'validation' WHEN 'rectangle' THEN 'controller' ELSE 'other' END AS layer FROM nodes")
register("b5_route_params", "modules", lambda m: scan.scan_express_routes(m).select("repo_id", "route").distinct().select("repo_id", "route", F.explode(paths.route_params(F.col("route"))).alias("p")).select("repo_id", "route", "p.name", "p.position", "p.optional"), f"""
SELECT repo_id, route, regexp_extract(x, '^:(\\w+)', 1) AS name, CAST(i - 1 AS INTEGER) AS position, x LIKE '%?' AS optional FROM (SELECT repo_id, route, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (
  SELECT repo_id, route, list_filter(string_split(route, '/'), lambda x: x <> '') AS a FROM (SELECT DISTINCT repo_id, found2 AS route FROM {findings_sql(scan.EXPRESS, 2)}))) WHERE regexp_extract(x, '^:(\\w+)', 1) <> ''""")
register("c3_scan_exports", "modules", scan.scan_exports, f"""SELECT DISTINCT repo_id, path, found1 AS name, CAST(line AS INTEGER) AS line FROM {findings_sql(scan.EXPORT)}
UNION SELECT DISTINCT repo_id, path, regexp_extract(trim(x), '^(\\w+)', 1), CAST(line AS INTEGER) FROM (SELECT repo_id, path, line, unnest(string_split(found1, ',')) AS x FROM {findings_sql(scan.EXPORT_LIST)}) WHERE regexp_extract(trim(x), '^(\\w+)', 1) <> ''""")
register("c8_scan_http_calls", "modules", scan.scan_http_calls, f"SELECT DISTINCT repo_id, path, 'fetch' AS method, found1 AS endpoint FROM {findings_sql(scan.ANY_FETCH)} UNION SELECT DISTINCT repo_id, path, upper(found1), found2 FROM {findings_sql(scan.AXIOS, 2)}")
register("c20_symbols", "modules", scan.script_symbols, " UNION ".join(f"SELECT DISTINCT repo_id, path, '{k}' AS kind, found1 AS name, CAST(line AS INTEGER) AS line FROM {findings_sql(p)}" for k, p in scan.SYMBOLS.items()))
register("c31_schema_fields", "modules", scan.schema_fields, f"SELECT DISTINCT repo_id, path, found1 AS name, found2 AS type FROM {findings_sql(scan.SCHEMA_FIELD, 2)}")
register("d17_unused_exports", "modules", lambda m: link.unused_exports(scan.scan_exports(m), scan.findings(m, r"import\s*\{\s*(\w+)").select("repo_id", F.get("found", F.lit(0)).alias("name")).distinct()), f"""
SELECT DISTINCT e.repo_id, e.path, e.name FROM ({ORACLE_SQL_BODY['c3']}) e WHERE NOT EXISTS (SELECT 1 FROM {findings_sql(r"import\s*\{\s*(\w+)")} i WHERE i.repo_id = e.repo_id AND i.found1 = e.name)""")
_STRINGS = f"SELECT DISTINCT repo_id, found1 AS candidate FROM {findings_sql(scan.ROUTE_STRING)} WHERE NOT regexp_matches(found1, '(?i)\\.[a-z0-9]{{2,5}}$') AND NOT starts_with(found1, '//') AND length(found1) <= 100"
register("d6_match_routes", "modules", lambda m: link.match_routes(scan.scan_route_strings(m).withColumnRenamed("route", "candidate"), paths.crawl_routes(m).select("repo_id", "route").unionByName(scan.controllers(m).select("repo_id", "route")).unionByName(scan.scan_express_routes(m).select("repo_id", "route")), inside=True), f"""
WITH c AS ({_STRINGS}), r AS (SELECT DISTINCT repo_id, route FROM (SELECT repo_id, route FROM ({_ROUTES}) UNION ALL SELECT repo_id, route FROM ({_SERVED}) UNION ALL SELECT repo_id, found2 FROM {findings_sql(scan.EXPRESS, 2)}) WHERE route <> '/'),
m AS (SELECT c.repo_id, c.candidate, r.route, CASE WHEN r.route = c.candidate THEN 1 WHEN contains(r.route, ':') AND len(string_split(r.route, '/')) = len(string_split(c.candidate, '/')) AND regexp_matches(c.candidate, '^' || regexp_replace(r.route, ':\\w+', '[^/]+', 'g') || '$') THEN 2
  WHEN starts_with(c.candidate, r.route || '/') THEN 3 WHEN length(r.route) >= 3 AND starts_with(r.route, '/') AND contains(c.candidate, r.route) THEN 4 END AS rung FROM c JOIN r USING (repo_id))
SELECT repo_id, candidate, route, CAST(rung AS INTEGER) AS rung FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, candidate ORDER BY rung, length(route) DESC, route) AS k FROM m WHERE rung IS NOT NULL) WHERE k = 1""")
register("d4_calls_to_controllers", "modules", lambda m: scan.scan_api_calls(m).withColumn("route", F.regexp_replace("endpoint", "(.)/+$", "$1")).join(scan.controllers(m).select("repo_id", "route", F.col("path").alias("controller")), ["repo_id", "route"], "left").select("repo_id", "path", "method", "endpoint", "controller"), f"""
SELECT a.repo_id, a.path, a.method, a.endpoint, s.path AS controller FROM ({_CALLS}) a LEFT JOIN ({_SERVED}) s ON a.repo_id = s.repo_id AND regexp_replace(a.endpoint, '(.)/+$', '\\1') = s.route""")

# --- further graphs -----------------------------------------------------------

register("a3_cap_files", "modules", cap_files, "SELECT repo_id, path FROM (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS k FROM (SELECT DISTINCT repo_id, path FROM modules)) WHERE k <= 100")


def _loaded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges of a loaded graph as one table; the smaller number of an end is an edge's age."""
    n = load_graph(nodes, "x", ["node_id"], 500).select("repo_id", F.lit("node").alias("kind"), F.col("node_id").alias("id"))
    aged = edges.groupBy("repo_id", "src", "dst").agg(F.min("kind").alias("kind")).withColumn("age", F.expr("cast(substring(dst, 2) AS BIGINT)"))
    e = load_graph(aged, "age", ["src", "dst"], 1000)
    return n.unionByName(e.select("repo_id", F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("id")))


register("a7_load_graph", "nodes edges", _loaded, """SELECT repo_id, 'node' AS kind, node_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY x, node_id) AS k FROM nodes) WHERE k <= 500
UNION ALL SELECT repo_id, 'edge', src || '>' || dst FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CAST(dst[2:] AS BIGINT), src, dst) AS k FROM (SELECT DISTINCT repo_id, src, dst FROM edges)) WHERE k <= 1000""")
register("a10_remap_endpoints", "nodes edges", lambda n, e: graph.remap_endpoints(e, n.select("repo_id", F.col("node_id").alias("label"), F.concat("type", F.lit(":"), "node_id").alias("node_id"))), f"SELECT repo_id, a || ':' || src AS src, b || ':' || dst AS dst FROM ({_TYPED})")
register("a11_cascade_delete", "nodes edges", lambda n, e: graph.cascade_delete(e, n.filter("y > 50")), "SELECT repo_id, src, dst, kind FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.y > 50 AND n.repo_id = e.repo_id AND n.node_id = e.src) AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.y > 50 AND n.repo_id = e.repo_id AND n.node_id = e.dst)")
register("d20_portal_links", "nodes edges sections", lambda n, e, s: graph.portal_links(e, link.assign_section(n, s).filter("section_id IS NOT NULL")), """WITH h AS (SELECT n.repo_id, n.node_id, min(s.section_id) AS section_id FROM nodes n JOIN sections s ON n.repo_id = s.repo_id AND n.x BETWEEN s.x AND s.x + s.w AND n.y BETWEEN s.y AND s.y + s.h GROUP BY ALL)
SELECT e.repo_id, e.src, e.dst, a.section_id AS src_section, b.section_id AS dst_section FROM edges e JOIN h a ON e.repo_id = a.repo_id AND e.src = a.node_id JOIN h b ON e.repo_id = b.repo_id AND e.dst = b.node_id WHERE a.section_id <> b.section_id""")
register("d26_merge_reference_edges", "edges", lambda e: e.filter("kind <> 'reference'").select("repo_id", "src", "dst").unionByName(e.filter("kind = 'reference'").select("repo_id", "src", "dst").join(e.filter("kind <> 'reference'").select("repo_id", "src", "dst"), ["repo_id", "src", "dst"], "left_anti")), "SELECT repo_id, src, dst FROM edges WHERE kind <> 'reference' UNION ALL SELECT repo_id, src, dst FROM edges e WHERE kind = 'reference' AND NOT EXISTS (SELECT 1 FROM edges b WHERE b.kind <> 'reference' AND b.repo_id = e.repo_id AND b.src = e.src AND b.dst = e.dst)")
register("e1_keep_first", "edges", lambda e: keep_first(e, ["repo_id", "src"], ["dst", "kind"]), "SELECT repo_id, src, dst, kind FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, src ORDER BY dst, kind) AS k FROM edges) WHERE k = 1")
register("e4_lane_positions", "nodes", lambda n: sequence.ranked(n, ["repo_id", "type"], ["y", "x", "node_id"], "position").select("repo_id", "type", "node_id", "position"), "SELECT repo_id, type, node_id, CAST(row_number() OVER (PARTITION BY repo_id, type ORDER BY y, x, node_id) AS INTEGER) AS position FROM nodes")
register("f9_issue_stats", "nodes edges", lambda n, e: graph.issues(n, e).groupBy("repo_id", "kind", "severity").agg(F.count(F.lit(1)).alias("n")), f"""SELECT repo_id, kind, severity, count(*) AS n FROM (
SELECT repo_id, 'god-class' AS kind, severity FROM ({ORACLE_SQL_BODY['f4']}) UNION ALL SELECT repo_id, 'oversized-file', severity FROM ({ORACLE_SQL_BODY['f5']}) UNION ALL SELECT repo_id, 'view-to-db', 'high' FROM ({_TYPED}) WHERE a = 'view' AND b = 'database'
UNION ALL SELECT repo_id, 'missing-validation', 'medium' FROM ({_GAPS}) UNION ALL SELECT repo_id, 'orphan', 'low' FROM ({ORACLE_SQL_BODY['d14']})) GROUP BY ALL""")
register("f10_churn", "changes", lambda c: c.groupBy("repo_id", "change").agg(F.round(F.sum("value"), 2).alias("total"), F.count(F.lit(1)).alias("n")), "SELECT repo_id, change, round(sum(value), 2) AS total, count(*) AS n FROM changes GROUP BY ALL")
register("g2_flow_trace", "nodes edges", lambda n, e: graph.flow_traces(n.filter(_ASKED), n, e), """WITH RECURSIVE v AS (SELECT e.repo_id, e.src, e.dst FROM edges e SEMI JOIN nodes a ON e.repo_id = a.repo_id AND e.src = a.node_id SEMI JOIN nodes b ON e.repo_id = b.repo_id AND e.dst = b.node_id),
ways AS (SELECT repo_id, 'forward' AS direction, src AS a, dst AS b FROM v UNION SELECT repo_id, 'backward', dst, src FROM v),
t AS (SELECT repo_id, node_id AS origin, direction, node_id, 0 AS d FROM nodes, (VALUES ('forward'), ('backward')) AS w(direction) WHERE CAST(node_id[2:] AS BIGINT) % 50 = 0
  UNION SELECT t.repo_id, t.origin, t.direction, x.b, t.d + 1 FROM t JOIN ways x ON x.repo_id = t.repo_id AND x.direction = t.direction AND x.a = t.node_id WHERE t.d < 50),
s AS (SELECT DISTINCT repo_id, 'forward' AS direction, src AS node_id FROM edges UNION SELECT DISTINCT repo_id, 'backward', dst FROM edges)
SELECT t.repo_id, t.origin, t.direction, t.node_id, min(t.d) AS depth, bool_and(s.node_id IS NULL) AS is_exit FROM t LEFT JOIN s ON s.repo_id = t.repo_id AND s.direction = t.direction AND s.node_id = t.node_id GROUP BY t.repo_id, t.origin, t.direction, t.node_id""")
# this asks from all nodes
register("g2_flow_trace_whole", "nodes edges", lambda n, e: graph.flow_traces(n, n, e, whole=True))
register("g4_cycles", "nodes edges", graph.cycle_nodes, """WITH RECURSIVE r AS (SELECT DISTINCT repo_id, src AS a, dst AS b FROM edges WHERE kind = 'reference' UNION SELECT r.repo_id, r.a, e.dst FROM r JOIN edges e ON e.repo_id = r.repo_id AND e.src = r.b AND e.kind = 'reference')
SELECT x.repo_id, x.a AS node_id, min(x.b) AS cycle FROM r x JOIN r y ON x.repo_id = y.repo_id AND x.a = y.b AND x.b = y.a GROUP BY ALL""")
_CLOSURE = f"""t AS (SELECT repo_id, path AS origin, path AS node_id, 0 AS d FROM ({_ROUTES}) UNION SELECT t.repo_id, t.origin, i.target, t.d + 1 FROM t JOIN imp i ON i.repo_id = t.repo_id AND i.path = t.node_id WHERE i.target IS NOT NULL AND t.d < 5)"""
register("g6_import_closure", "modules", lambda m: graph.import_closure(paths.crawl_routes(m), link.import_edges(m)))
register("f7_shared_components", "modules", lambda m: graph.shared_components(graph.import_closure(paths.crawl_routes(m), link.import_edges(m))))
register("g9_bypass_paths", "nodes edges", graph.bypass_paths, f"""WITH t AS ({_TYPED}), s2 AS (SELECT DISTINCT x.repo_id, x.src, y.dst, y.b FROM t x JOIN t y ON x.repo_id = y.repo_id AND x.dst = y.src WHERE x.a = 'view' AND x.b <> 'controller'),
s3 AS (SELECT DISTINCT x.repo_id, x.src, y.dst, y.b FROM s2 x JOIN t y ON x.repo_id = y.repo_id AND x.dst = y.src WHERE x.b <> 'controller')
SELECT DISTINCT repo_id, src, dst FROM (SELECT * FROM s2 UNION ALL SELECT * FROM s3) p WHERE b = 'database' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = p.repo_id AND e.src = p.src AND e.dst = p.dst)""")
register("g12_longest_path_rank", "nodes edges", graph.longest_path_rank)
register("g14_dag_share", "nodes edges", graph.dag_share)
register("g15_execution_order", "nodes edges", graph.execution_order, """WITH RECURSIVE t AS (SELECT repo_id, node_id, 0 AS d FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = n.repo_id AND e.dst = n.node_id) UNION SELECT t.repo_id, e.dst, t.d + 1 FROM t JOIN edges e ON e.repo_id = t.repo_id AND e.src = t.node_id WHERE t.d < 200)
SELECT n.repo_id, n.node_id, coalesce(min(t.d), -1) AS depth FROM nodes n LEFT JOIN t USING (repo_id, node_id) GROUP BY ALL""")
register("f13_impact_counts", "nodes edges", lambda n, e: graph.blast_radius(n.filter(_ASKED), e).groupBy("repo_id", "origin", "category").agg(F.count(F.lit(1)).alias("n")), f"SELECT repo_id, origin, category, count(*) AS n FROM ({ORACLE_SQL_BODY['g1']}) GROUP BY ALL")
register("f15_many_to_many", "modules", lambda m: schema.many_to_many(schema.schema_catalog(_ddl(m).withColumn("source", F.regexp_replace("source", "name VARCHAR", "post_id INTEGER REFERENCES posts(id), name VARCHAR")))), """WITH f AS (SELECT repo_id, path, min(source) AS source FROM modules WHERE path LIKE '%.sql' GROUP BY ALL), t AS (SELECT repo_id, path, regexp_extract(source, 'CREATE TABLE (\\w+)', 1) AS junction FROM f)
SELECT repo_id, path, junction, 'posts' AS table_a, 'users' AS table_b FROM t WHERE junction NOT IN ('users', 'posts')""")
register("h2_universal_type", "modules", lambda m: schema.schema_catalog(_ddl(m)).groupBy("repo_id", "raw_type", "type").agg(F.count(F.lit(1)).alias("n")), """WITH f AS (SELECT DISTINCT repo_id, path FROM modules WHERE path LIKE '%.sql')
SELECT repo_id, raw_type, type, count(*) AS n FROM f CROSS JOIN (VALUES ('SERIAL', 'INTEGER'), ('VARCHAR(40)', 'TEXT'), ('NUMERIC(10, 2)', 'NUMERIC'), ('INTEGER', 'INTEGER')) AS c(raw_type, type) GROUP BY ALL""")
register("h4_native_type", "modules", lambda m: schema.schema_catalog(_ddl(m)).groupBy("repo_id", "type", schema.native_type(F.col("type"), "sqlite").alias("native")).agg(F.count(F.lit(1)).alias("n")), """WITH f AS (SELECT DISTINCT repo_id, path FROM modules WHERE path LIKE '%.sql')
SELECT repo_id, type, native, count(*) AS n FROM f CROSS JOIN (VALUES ('INTEGER', 'INTEGER'), ('TEXT', 'TEXT'), ('NUMERIC', 'REAL'), ('INTEGER', 'INTEGER')) AS c(type, native) GROUP BY ALL""")
register("i3_required_names", "modules", lambda m: scan.env_variables(m).filter("required").select("repo_id", "name").distinct(), f"SELECT DISTINCT repo_id, name FROM ({_ENV}) WHERE required")
register("k6_sync_actions", "nodes", lambda n: n.select("repo_id", "node_id", paths.target_file(F.col("label"), F.col("shape")).alias("file")), """SELECT repo_id, node_id, CASE WHEN starts_with(label, '/api/') THEN 'app/api/' || regexp_replace(label, '^/api/+', '') || '/route.ts' WHEN starts_with(label, '/') THEN 'app/' || regexp_replace(label, '^/+', '') || '/page.tsx'
  WHEN shape = 'cylinder' THEN 'lib/models/' || regexp_replace(label, '[^a-zA-Z0-9]', '_', 'g') || '.ts' ELSE 'lib/' || regexp_replace(label, '[^a-zA-Z0-9]', '_', 'g') || '.ts' END AS file FROM nodes""")
