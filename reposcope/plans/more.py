"""More registered queries: languages, navigation, matches by text, paths through graphs, and the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.functions import paths
from reposcope.functions.text import findings_sql, keep_first, positions_sql
from reposcope.operators import code, graph, infra, journey, link, match, navigation, parse, scan, schema, sequence
from reposcope.plans.queries import _ENV, _HAS, _ROUTES, _SERVED, _TYPED, _VERB_CASES, ORACLE_SQL_BODY, _tidy, register
from reposcope.sources.tables import file_nodes, filter_source_files, graph_lines, read_graph, upsert, written
from reposcope.streaming import feed


def _q(pattern: str) -> str:
    """A pattern in SQL quotes; RE2 is linear without possessive loops."""
    return "'" + pattern.replace("*+", "*").replace("'", "''") + "'"


def _on(sql: str, table: str) -> str:
    """SQL over the modules table, over another one."""
    return sql.replace("FROM modules", f"FROM {table}")


# --- sources ------------------------------------------------------------------

register("a2_filter_source_files", "modules", lambda m: filter_source_files(m, ["ts", "tsx"], exclude="^app/api/").select("repo_id", "path").distinct(), """
SELECT DISTINCT repo_id, path FROM modules WHERE lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('ts', 'tsx') AND NOT regexp_matches(path, '^app/api/')""")
_old = lambda e: e.filter("kind <> 'query'")
_new = lambda e: e.filter("kind IN ('query', 'validate')").withColumn("kind", F.concat(F.lit("new-"), "kind"))
register("a5_upsert_edges", "edges", lambda e: upsert(_old(e), _new(e), ["repo_id", "src", "dst"], ["kind"]), """WITH n AS (SELECT repo_id, src, dst, min('new-' || kind) AS kind FROM edges WHERE kind IN ('query', 'validate') GROUP BY ALL)
SELECT repo_id, src, dst, kind FROM n UNION ALL SELECT repo_id, src, dst, kind FROM edges e ANTI JOIN n USING (repo_id, src, dst) WHERE kind <> 'query'""")
_KIND_CASE = lambda i, other: "CASE " + " ".join(f"WHEN regexp_matches(path, {_q(k[0])}) THEN '{k[i]}'" for k in file_kinds) + f" ELSE '{other}' END"
from reposcope.sources.tables import FILE_KINDS as file_kinds  # noqa: E402

register("a6_sync_file_nodes", "modules", file_nodes, f"""SELECT repo_id, label, {_KIND_CASE(1, 'File · Source')} AS sub, {_KIND_CASE(2, 'rectangle')} AS shape
FROM (SELECT repo_id, list_extract(string_split(path, '/'), -1) AS label, min(path) AS path FROM modules GROUP BY ALL)""")


def _read_back(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What reading the exported lines gives, counted by repository, kind and type."""
    n, e = read_graph(graph_lines(nodes, edges))
    both = n.select("repo_id", F.lit("node").alias("part"), F.col("type").alias("kind"), F.length("label").alias("size")).unionByName(e.select("repo_id", F.lit("edge").alias("part"), "kind", F.length(F.concat("src", "dst")).alias("size")))
    return both.groupBy("repo_id", "part", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"))


register("a12_read_graph_json", "nodes edges", _read_back, """SELECT repo_id, part, kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS chars FROM (
SELECT repo_id, 'node' AS part, type AS kind, length(label) AS size FROM nodes UNION ALL SELECT repo_id, 'edge', kind, length(src || dst) FROM edges) GROUP BY ALL""")

# --- paths --------------------------------------------------------------------

_APP, _PAGES = "regexp_extract(path, '(?:^|/)app/(.+)/page\\.(?:tsx|ts|js|jsx)$', 1)", "regexp_extract(path, '(?:^|/)pages/(.+)\\.(?:tsx|ts|js|jsx)$', 1)"
_SEG = f"CASE WHEN {_APP} <> '' THEN {_APP} WHEN regexp_matches(path, {_q(navigation.PAGE_FILES)}) THEN 'index' ELSE {_PAGES} END"
_NAMED = "regexp_replace(regexp_replace(regexp_replace(seg, '\\[\\[?(\\w+)\\]?\\]', ':\\1', 'g'), '\\([^)]+\\)', '', 'g'), '/index$', '')"
register("b7_page_routes", "screens", navigation.page_routes, f"""SELECT repo_id, route, CASE WHEN route = '/' THEN '/ (Home)' ELSE route END AS label, min_by(sub, path) AS sub, min(path) AS path FROM (
SELECT repo_id, path, CASE WHEN seg = 'index' THEN '/' ELSE {_tidy(_NAMED)} END AS route, CASE WHEN regexp_matches(path, '(?:^|/)app/') THEN 'App Router' ELSE 'Pages Router' END AS sub FROM (
  SELECT repo_id, path, {_SEG} AS seg FROM screens WHERE regexp_matches(path, {_q(navigation.PAGE_FILES)}) OR ({_PAGES} <> '' AND NOT regexp_matches({_PAGES}, '^(api/|_)|^(404|500)$')))) GROUP BY repo_id, route""")


def _urls(screens: DataFrame) -> DataFrame:
    """URLs of the screens' links that fit a route with parameters, and the parameters' values."""
    routes = paths.crawl_routes(screens).filter(F.col("route").contains(":")).select("repo_id", "route")
    both = link.fitting(navigation.scan_route_refs(screens).select("repo_id", F.col("literal").alias("candidate")), routes).withColumnRenamed("candidate", "url")
    return both.select("repo_id", "route", "url", F.to_json(paths.url_params(F.col("route"), F.col("url"))).alias("params"))


_REFS = " UNION ".join(f"SELECT repo_id, path, '{t}' AS type, regexp_extract(match, {_q(p)}, 1) AS literal, {w} AS confidence, line, trim(regexp_replace(source[greatest(spot - 50, 0) + 1 : spot + 50], '\\s+', ' ', 'g')) AS context FROM {positions_sql(p, 'screens')}" for t, w, p in navigation.REFERENCES)
_REFS = f"SELECT * FROM ({_REFS}) WHERE regexp_matches(literal, {_q(navigation.ROUTE_SIGNS)}) AND length(literal) <= 100 AND NOT starts_with(literal, '/data:') AND (starts_with(literal, '/api/') OR NOT regexp_matches(literal, '\\.[a-z]{{2,4}}$'))"
register("c14_scan_route_refs", "screens", navigation.scan_route_refs, f"SELECT repo_id, path, type, literal, CAST(confidence AS DOUBLE) AS confidence, line, context FROM ({_REFS})")
_SROUTES = _on(_ROUTES, "screens")
register("b16_url_params", "screens", _urls, f"""WITH u AS (SELECT DISTINCT repo_id, literal AS url FROM ({_REFS})), r AS (SELECT repo_id, route FROM ({_SROUTES}) WHERE contains(route, ':'))
SELECT repo_id, route, url, '{{' || array_to_string(list_filter(list_transform(generate_series(1, len(string_split(route, '/'))), lambda i: CASE WHEN starts_with(string_split(route, '/')[i], ':') THEN '"' || string_split(route, '/')[i][2:] || '":"' || string_split(url, '/')[i] || '"' END), lambda x: x IS NOT NULL), ',') || '}}' AS params
FROM u JOIN r USING (repo_id) WHERE regexp_matches(url, '^' || regexp_replace(route, ':\\w+', '[^/]+', 'g') || '$')""")
register("e2_sort_routes", "modules", lambda m: sequence.sorted_routes(scan.scan_express_routes(m).select("repo_id", "route").unionByName(paths.crawl_routes(m).select("repo_id", "route"))), f"""
SELECT repo_id, route, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN contains(route, '*') THEN 2 WHEN contains(route, ':') THEN 1 ELSE 0 END, route) AS INTEGER) AS position FROM (
  SELECT DISTINCT repo_id, found2 AS route FROM {findings_sql(scan.EXPRESS, 2)} UNION SELECT repo_id, route FROM ({_ROUTES}))""")

# --- screens ------------------------------------------------------------------

_INTER = " UNION ".join(
    [f"SELECT repo_id, path, '{k}' AS kind, found1 AS target, CAST(line AS INTEGER) AS line FROM {findings_sql(p, 1, 'screens')}" for k, p in navigation.INTERACTIONS]
    + [f"SELECT repo_id, path, '{k}', coalesce(nullif(regexp_extract(source[spot + 1 : spot + {navigation.HANDLER_CHARS}], {_q(t)}, 1), ''), '{o}'), line FROM {positions_sql(p, 'screens')}" for k, p, t, o in navigation.HANDLERS]
)
register("c4_scan_interactions", "screens", navigation.scan_interactions, _INTER)
_GATE_ROWS = " UNION ALL ".join(f"SELECT repo_id, path, '{k}' AS kind, {i} AS rank, {chr(39) + l + chr(39) + (' || found1' if l.startswith('Guard') else '')} AS label, CAST(line AS INTEGER) AS line FROM {findings_sql(p, 1, 'screens')}" for i, (k, l, p) in enumerate(navigation.GATES))
_GATES = f"SELECT repo_id, path, kind, line, rank, label FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, kind, line ORDER BY rank, label) AS k FROM ({_GATE_ROWS})) WHERE k = 1"
register("c5_scan_gates", "screens", lambda m: navigation.scan_gates(m).drop("rank"), f"SELECT repo_id, path, kind, label, line FROM ({_GATES})")
_CLEANED = "CASE WHEN starts_with(c, '/') THEN c ELSE '/' || c END"
_TARGETS = f"""SELECT repo_id, target, {_CLEANED} AS c FROM (SELECT DISTINCT repo_id, target, regexp_replace(regexp_replace(regexp_replace(trim(target), '[?#].*$', ''), '^\\./', '/'), '^\\.\\./', '/') AS c FROM ({_INTER}))"""
_TO = f"""SELECT repo_id, target, route FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, target ORDER BY rung, length(route) DESC, route) AS k FROM (
  SELECT t.repo_id, t.target, r.route, CASE WHEN r.route = t.c THEN 1 WHEN contains(r.route, ':') AND len(string_split(r.route, '/')) = len(string_split(t.c, '/')) AND regexp_matches(t.c, '^' || regexp_replace(r.route, ':\\w+', '[^/]+', 'g') || '$') THEN 2 WHEN r.route <> '/' AND starts_with(t.c, r.route || '/') THEN 3 END AS rung
  FROM ({_TARGETS}) t JOIN ({_SROUTES}) r USING (repo_id)) WHERE rung IS NOT NULL) WHERE k = 1"""
register("d5_targets_to_routes", "screens", lambda m: navigation.targets_to_routes(navigation.scan_interactions(m), paths.crawl_routes(m)), _TO)
_NAV = f"""WITH p AS (SELECT repo_id, path, route AS page FROM ({_SROUTES})), i AS (SELECT DISTINCT x.repo_id, x.path, p.page, x.line, t.route FROM ({_INTER}) x JOIN p ON x.repo_id = p.repo_id AND x.path = p.path JOIN ({_TO}) t ON x.repo_id = t.repo_id AND x.target = t.target),
g AS (SELECT repo_id, path, page, line, route, 'gate:' || path || ':' || kind || ':' || gl AS gate FROM (SELECT i.*, g.kind, g.line AS gl, row_number() OVER (PARTITION BY i.repo_id, i.path, i.page, i.line, i.route ORDER BY g.rank, g.line, g.kind) AS k FROM i JOIN ({_GATES}) g ON i.repo_id = g.repo_id AND i.path = g.path AND g.line < i.line) WHERE k = 1)
SELECT repo_id, 'page:' || page AS src, gate AS dst, 'action' AS label FROM g UNION SELECT repo_id, gate, 'page:' || route, 'success' FROM g UNION SELECT repo_id, gate, 'error:' || path, 'failure' FROM g
UNION SELECT repo_id, 'page:' || page, 'page:' || route, '' FROM i ANTI JOIN g USING (repo_id, path, line, route)"""
register("d27_nav_edges", "screens", navigation.nav_edges, _NAV)
_SIMILAR = f"""SELECT repo_id, candidate, route, CAST(rung AS INTEGER) AS rung FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, candidate ORDER BY rung, route) AS k FROM (
  SELECT c.repo_id, c.candidate, r.route, CASE WHEN r.route = c.candidate THEN 1 WHEN length(c.candidate) > 1 AND regexp_replace(c.candidate, '/$', '') = r.route THEN 2
    WHEN contains(r.route, ':') AND regexp_matches(c.candidate, '^' || regexp_replace(regexp_replace(regexp_replace(r.route, ':\\w+\\*', '.+', 'g'), ':\\w+\\?', '[^/]*', 'g'), ':\\w+', '[^/]+', 'g') || '$') THEN 3
    WHEN (starts_with(r.route, c.candidate) OR starts_with(c.candidate, string_split(r.route, '/:')[1])) AND len(list_intersect(list_distinct(string_split(c.candidate, '')), list_distinct(string_split(r.route, '')))) / len(list_distinct(string_split(c.candidate || r.route, ''))) > 0.6 THEN 4 END AS rung
  FROM (SELECT DISTINCT repo_id, literal AS candidate FROM ({_REFS})) c JOIN ({_SROUTES}) r USING (repo_id)) WHERE rung IS NOT NULL) WHERE k = 1"""
register("d7_similar_routes", "screens", lambda m: navigation.similar_routes(written(navigation.scan_route_refs(m).select("repo_id", F.col("literal").alias("candidate"))), written(paths.crawl_routes(m))), _SIMILAR)
_BEST = f"SELECT f.repo_id, f.path, s.route, max(CAST(f.confidence AS DOUBLE)) AS confidence FROM ({_REFS}) f JOIN ({_SIMILAR}) s ON f.repo_id = s.repo_id AND f.literal = s.candidate WHERE f.confidence >= 0.5 GROUP BY ALL"
register("e3_best_refs", "screens", navigation.route_references, _BEST)
register("g20_nav_graph", "screens", navigation.nav_graph, f"""WITH e AS ({_NAV}), pg AS (SELECT repo_id, path, route AS page FROM ({_SROUTES})), quiet AS (SELECT repo_id, path, page FROM pg ANTI JOIN (SELECT DISTINCT repo_id, src[6:] AS page FROM e) x USING (repo_id, page)),
st AS (SELECT DISTINCT repo_id, path, literal AS c FROM ({_REFS}) WHERE type = 'inferred'), m AS (SELECT st.repo_id, st.path, q.page, r.route, row_number() OVER (PARTITION BY st.repo_id, st.path, st.c, q.page ORDER BY
  CASE WHEN r.route = st.c THEN 1 WHEN contains(r.route, ':') AND len(string_split(r.route, '/')) = len(string_split(st.c, '/')) AND regexp_matches(st.c, '^' || regexp_replace(r.route, ':\\w+', '[^/]+', 'g') || '$') THEN 2 ELSE 3 END, length(r.route) DESC, r.route) AS k
  FROM st JOIN quiet q ON st.repo_id = q.repo_id AND st.path = q.path JOIN ({_SROUTES}) r ON r.repo_id = st.repo_id AND r.route <> '/' AND (r.route = st.c OR starts_with(st.c, r.route || '/') OR (contains(r.route, ':') AND len(string_split(r.route, '/')) = len(string_split(st.c, '/')) AND regexp_matches(st.c, '^' || regexp_replace(r.route, ':\\w+', '[^/]+', 'g') || '$'))))
SELECT * FROM e UNION ALL SELECT DISTINCT repo_id, 'page:' || page, 'page:' || route, 'inferred' FROM m WHERE k = 1 AND page <> route""")

# --- languages ----------------------------------------------------------------

_LANGS = "CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGES.items()) + " END"
_each = [(lang, kind, p) for lang, rules in code.RULES.items() for kind, p in rules]
_KINDS = "CASE " + " ".join(f"WHEN language = '{a}' AND regexp_matches(bare, {_q(p)}) THEN {i}" for i, (a, _, p) in enumerate(_each)) + " END"
_GROUP = lambda g: "CASE r " + " ".join(f"WHEN {i} THEN regexp_extract(bare, {_q(p)}, {g})" for i, (_, _, p) in enumerate(_each)) + " END"
_SYMBOLS = f"""SELECT repo_id, path, language, line, kind, name, rest, CASE WHEN kind <> 'class' AND indent > o.i THEN o.n END AS owner FROM (
  SELECT *, last_value(CASE WHEN kind = 'class' THEN {{'n': name, 'i': indent}} END IGNORE NULLS) OVER (PARTITION BY repo_id, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM (
    SELECT repo_id, path, language, line, indent, CASE r {' '.join(f"WHEN {i} THEN '{k}'" for i, (_, k, _) in enumerate(_each))} END AS kind, {_GROUP(1)} AS name, {_GROUP(2)} AS rest FROM (
      SELECT *, {_KINDS} AS r FROM (SELECT repo_id, path, language, CAST(line AS INTEGER) AS line, trim(text) AS bare, length(text) - length(ltrim(text)) AS indent FROM (
        SELECT repo_id, path, {_LANGS} AS language, generate_subscripts(string_split(source, chr(10)), 1) AS line, unnest(string_split(source, chr(10))) AS text FROM code))
      WHERE NOT regexp_matches(bare, '^(//|\\*|/\\*|--)') AND (NOT starts_with(bare, '#') OR starts_with(bare, '#include'))) WHERE r IS NOT NULL)
    WHERE name NOT IN ({', '.join(repr(x) for x in code.NO_FUNCTIONS)}))"""
register("c20_language_symbols", "code", code.symbols, _SYMBOLS)
_PARENT = "regexp_replace(trim(x), '^(public|private|protected|virtual)\\s+', '')"
_INHERIT = f"SELECT DISTINCT repo_id, path, name AS src, p AS dst FROM (SELECT repo_id, path, name, {_PARENT} AS p FROM (SELECT repo_id, path, name, unnest(string_split(regexp_replace(rest, '<[^>]*>', '', 'g'), ',')) AS x FROM ({_SYMBOLS}) WHERE kind = 'class' AND language <> 'go' AND rest <> '')) WHERE regexp_matches(p, '^[\\w.:]+$')"
register("c21_inherit_edges", "code", lambda m: code.inherit_edges(code.symbols(m)), _INHERIT)
_PHP = r"Route::(\w+)\(\s*['\"]([^'\"]+)['\"]\s*,\s*\[?([\w:]+)::class\s*,\s*['\"](\w+)['\"]\]?\)"
_MAPPED = f"""SELECT DISTINCT repo_id, path, upper(regexp_replace(regexp_replace(name, 'Mapping$', ''), '^Http', '')) AS verb, coalesce(nullif(regexp_extract(rest, '["'']([^"'']+)["'']', 1), ''), '/') AS route, below AS owner FROM (
  SELECT *, first_value(CASE WHEN kind = 'function' THEN concat_ws('.', owner, name) END IGNORE NULLS) OVER (PARTITION BY repo_id, path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM ({_SYMBOLS}))
  WHERE kind = 'annotation' AND below IS NOT NULL AND ((language = 'java' AND name LIKE '%Mapping') OR (language = 'csharp' AND regexp_matches(name, '^Http(Get|Post|Put|Delete|Patch)$')))
UNION SELECT repo_id, path, upper(regexp_extract(text, {_q(_PHP)}, 1)), regexp_extract(text, {_q(_PHP)}, 2), regexp_extract(text, {_q(_PHP)}, 3) || '.' || regexp_extract(text, {_q(_PHP)}, 4)
  FROM (SELECT repo_id, path, unnest(string_split(source, chr(10))) AS text FROM code WHERE path LIKE '%.php') WHERE regexp_matches(text, {_q(_PHP)})"""
register("c22_annotated_routes", "code", code.annotated_routes, _MAPPED)


def _calls_sql(language: str) -> str:
    return f"""(WITH y AS (SELECT *, concat_ws('.', owner, name) AS id FROM ({_SYMBOLS}) WHERE language = '{language}'), d AS (SELECT DISTINCT repo_id, path, id FROM y WHERE kind IN ('function', 'class')),
l AS (SELECT repo_id, path, generate_subscripts(string_split(source, chr(10)), 1) AS line, unnest(string_split(source, chr(10))) AS text FROM code WHERE {_LANGS} = '{language}'),
b AS (SELECT repo_id, path, text, last_value(id IGNORE NULLS) OVER w AS src, last_value(CASE WHEN id IS NOT NULL THEN coalesce(owner, '') END IGNORE NULLS) OVER w AS o, id FROM (SELECT l.*, y.id, y.owner FROM l LEFT JOIN y ON l.repo_id = y.repo_id AND l.path = y.path AND l.line = y.line AND y.kind = 'function')
  WINDOW w AS (PARTITION BY repo_id, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT repo_id, path, src, o, unnest(regexp_extract_all(replace(text, '$', ''), {_q(code.CALL)}, 1)) AS call FROM b WHERE id IS NULL AND src IS NOT NULL),
t AS (SELECT DISTINCT repo_id, path, src, CASE WHEN regexp_matches(call, '^(?:self|cls|this|static)(?:\\.|->|::)(\\w+)$') THEN concat_ws('.', nullif(o, ''), regexp_extract(call, '(\\w+)$', 1)) ELSE regexp_replace(call, '(->|::)', '.') END AS dst FROM c)
SELECT t.repo_id, t.path, t.src, t.dst FROM t SEMI JOIN d ON t.repo_id = d.repo_id AND t.path = d.path AND t.dst = d.id)"""


register("c23_call_graph_python", "code", lambda m: code.call_edges(m, "python"), f"SELECT * FROM {_calls_sql('python')}")
register("c24_call_graph_php", "code", lambda m: code.call_edges(m, "php"), f"SELECT * FROM {_calls_sql('php')}")
_LINES = "SELECT repo_id, path, generate_subscripts(string_split(source, chr(10)), 1) AS line, unnest(string_split(source, chr(10))) AS text FROM (SELECT * FROM code UNION ALL SELECT * FROM screens)"
_SOME = lambda p: f"nullif(regexp_extract(text, {_q(p)}, 1), '')"
_SCRIPTED = f"coalesce({_SOME(code.IMPORT_LINE)}, {_SOME(code.REQUIRE_LINE)})"
_IMPORT_LINES = f"""SELECT repo_id, path, specifier, CAST(min(line) AS INTEGER) AS line FROM (SELECT repo_id, path, line, CASE WHEN {_SCRIPTED} IS NOT NULL THEN CASE WHEN regexp_matches({_SCRIPTED}, '^(\\.|@/|/)') THEN {_SCRIPTED} END
  WHEN path LIKE '%.py' THEN coalesce({_SOME(code.PY_FROM)}, {_SOME(code.PY_IMPORT)}) END AS specifier FROM ({_LINES})) WHERE specifier IS NOT NULL GROUP BY ALL"""
register("c2_scan_imports_lines", "code screens", lambda c, s: code.import_lines(c.unionByName(s)), _IMPORT_LINES)
_MODEL_PARTS = " UNION ALL ".join(f"SELECT repo_id, path, unnest(regexp_extract_all(lower(source), {_q(p)}, 1)) AS x, {i} AS i FROM screens" for i, (p, _) in enumerate(code.MODELS))
_MODELS = f"SELECT DISTINCT repo_id, path, trim(translate(x, '-_', '  ')) AS model FROM ({_MODEL_PARTS}) WHERE NOT (i = 3 AND x IN ({', '.join(repr(x) for x in code.MODELS[3][1])})) AND trim(translate(x, '-_', '  ')) <> ''"
register("c27_imported_models", "screens", code.imported_models, _MODELS)


def _unified(files: DataFrame) -> DataFrame:
    nodes, edges = code.unified_graph(files, link.import_edges(files))
    return nodes.select("repo_id", F.lit("node").alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), "kind").unionByName(edges.select("repo_id", F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), "kind"))


register("g21_unified_graph", "code", _unified, f"""SELECT repo_id, 'node' AS part, a, '' AS b, kind FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, a ORDER BY rank, kind) AS k FROM (
  SELECT DISTINCT repo_id, path AS a, 0 AS rank, 'module' AS kind FROM code UNION ALL SELECT repo_id, path || '#' || concat_ws('.', owner, name), 1, kind FROM ({_SYMBOLS}) WHERE kind IN ('class', 'function'))) WHERE k = 1
UNION ALL SELECT repo_id, 'edge', a, b, kind FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, a, b ORDER BY rank) AS k FROM (
  SELECT repo_id, path || '#' || src AS a, path || '#' || dst AS b, 1 AS rank, 'inherit' AS kind FROM ({_INHERIT}) UNION ALL SELECT repo_id, verb || ' ' || route, path || '#' || owner, 2, 'route' FROM ({_MAPPED})
  UNION ALL SELECT repo_id, path || '#' || src, path || '#' || dst, 3, 'reference' FROM {_calls_sql('python')} UNION ALL SELECT repo_id, path || '#' || src, path || '#' || dst, 4, 'reference' FROM {_calls_sql('php')})) WHERE k = 1""")

# --- matches by text ----------------------------------------------------------

_PIECE = "replace(replace(specifier, './', ''), '@/', '')"
register("d3_resolve_import_contains", "screens modules", lambda s, m: match.resolve_import_contains(code.import_lines(s), m), f"""SELECT i.repo_id, i.specifier, min(m.path) AS target FROM (SELECT DISTINCT repo_id, specifier FROM ({_IMPORT_LINES.replace('(SELECT * FROM code UNION ALL SELECT * FROM screens)', 'screens')}) WHERE regexp_matches(specifier, '^(\\.|@/)')) i
LEFT JOIN modules m ON i.repo_id = m.repo_id AND {_PIECE} <> '' AND contains(m.path, {_PIECE}) GROUP BY ALL""")
_PLAIN = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
_STEM = "regexp_replace(list_extract(string_split(path, '/'), -1), '\\.(ts|tsx|js|jsx)$', '')"
_FILE_NODES = "SELECT DISTINCT repo_id, path AS node_id, " + _STEM + " || ' node' AS label FROM modules WHERE path LIKE '%page.tsx' OR path LIKE 'src/lib/%'"


def _file_nodes(m: DataFrame) -> DataFrame:
    return m.filter("path LIKE '%page.tsx' OR path LIKE 'src/lib/%'").select("repo_id", F.col("path").alias("node_id"), F.concat(match.file_stem("path"), F.lit(" node")).alias("label")).distinct()


register("d10_attach_by_label", "modules", lambda m: match.attach_by_label(_file_nodes(m), scan.env_variables(m)), f"""WITH n AS (SELECT repo_id, node_id, {_PLAIN('label')} AS l FROM ({_FILE_NODES})), f AS (SELECT DISTINCT repo_id, path, {_PLAIN(_STEM)} AS s FROM ({_ENV}))
SELECT DISTINCT n.repo_id, n.node_id, f.path FROM n JOIN f ON n.repo_id = f.repo_id AND l <> '' AND s <> '' AND (contains(l, s) OR contains(s, l))""")


def _parts(m: DataFrame) -> DataFrame:
    """A controller node for each served route and a table node for each name."""
    served = scan.controllers(m).select("repo_id", F.concat(F.lit("c"), "route").alias("node_id"), F.col("route").alias("label"), F.lit("rectangle").alias("shape"), F.lit("controller").alias("type"))
    tables = scan.scan_table_names(m).select("repo_id", F.concat(F.lit("t"), F.lower("table_name")).alias("node_id"), F.col("table_name").alias("label"), F.lit("cylinder").alias("shape"), F.lit("database").alias("type")).distinct()
    return served.unionByName(tables)


_TS_TABLES = f"SELECT DISTINCT repo_id, path, table_name FROM ({ORACLE_SQL_BODY['c10']}) WHERE context IN ('query', 'raw SQL') AND regexp_matches(path, '\\.tsx?$')"
register("d9_cross_reference", "modules", lambda m: match.cross_reference(_parts(m), m), f"""WITH n AS (SELECT repo_id, 'c' || route AS src, {_PLAIN('route')} AS l FROM ({_SERVED})), t AS (SELECT *, {_PLAIN('path')} AS k FROM ({_TS_TABLES})), d AS (SELECT DISTINCT repo_id, lower(table_name) AS low FROM ({ORACLE_SQL_BODY['c10']}))
SELECT DISTINCT n.repo_id, n.src, 't' || d.low AS dst, t.table_name FROM n JOIN t ON n.repo_id = t.repo_id AND l <> '' AND (contains(k, l) OR contains(l, k)) JOIN d ON d.repo_id = t.repo_id AND d.low = lower(t.table_name)""")


def _actions(s: DataFrame, m: DataFrame) -> DataFrame:
    acts = s.select("repo_id", F.col("path").alias("src")).distinct().join(code.imported_models(s).withColumnRenamed("path", "src"), ["repo_id", "src"], "left")
    return match.models_to_tables(acts, _parts(m).filter("type = 'database'").select("repo_id", F.col("node_id").alias("dst"), "label"))


register("d13_models_to_tables", "screens modules", _actions, f"""WITH a AS (SELECT DISTINCT s.repo_id, s.path AS src, m.model FROM screens s LEFT JOIN ({_MODELS}) m ON s.repo_id = m.repo_id AND s.path = m.path), t AS (SELECT DISTINCT repo_id, 't' || lower(table_name) AS dst, lower(table_name) AS l FROM ({ORACLE_SQL_BODY['c10']})),
f AS (SELECT DISTINCT a.repo_id, a.src, t.dst FROM a JOIN t ON a.repo_id = t.repo_id AND (contains(t.l, a.model) OR contains(a.model, t.l)))
SELECT * FROM f UNION ALL SELECT x.repo_id, x.src, min(t.dst) FROM (SELECT DISTINCT repo_id, src FROM a ANTI JOIN f USING (repo_id, src)) x JOIN t ON x.repo_id = t.repo_id GROUP BY ALL""")


def _uploads(s: DataFrame, n: DataFrame) -> DataFrame:
    views = navigation.page_routes(s).select("repo_id", F.col("route").alias("node_id"), F.regexp_replace("route", "^/(\\w+).*$", "/$1").alias("label"))
    return match.upload_edges(s, views, n.filter("type = 'database'"))


register("c30_upload_edges", "screens nodes", _uploads, f"""WITH v AS (SELECT repo_id, route AS node_id, lower(replace(regexp_replace(route, '^/(\\w+).*$', '/\\1'), '/', '')) AS l FROM ({ORACLE_SQL_BODY['b7']})), d AS (SELECT repo_id, min(node_id) AS dst FROM nodes WHERE type = 'database' GROUP BY ALL),
u AS (SELECT DISTINCT repo_id, path FROM screens WHERE contains(source, 'type="file"') OR contains(source, 'FormData') OR contains(source, 'multipart') OR contains(source, '.upload('))
SELECT DISTINCT repo_id, src, dst FROM (SELECT u.repo_id, u.path, min(v.node_id) AS src FROM u JOIN v ON u.repo_id = v.repo_id AND l <> '' AND contains(lower(u.path), l) GROUP BY ALL) JOIN d USING (repo_id)""")
_CAT = _on(ORACLE_SQL_BODY["b10"], "sources").replace("SELECT DISTINCT repo_id, path,", "SELECT DISTINCT repo_id, path, lower(source) AS low,")
_NODE_LABEL = _on(ORACLE_SQL_BODY["b12"], "sources")
register("d12_arch_edges", "sources", match.arch_edges, f"""WITH k AS ({_CAT}), lg AS (SELECT DISTINCT repo_id, path AS dst, lower(path) AS w FROM k WHERE category = 'LOGIC_NODE'), db AS (SELECT k.repo_id, lower(b.label) AS name, min(k.path) AS dst FROM k JOIN ({_NODE_LABEL}) b ON k.repo_id = b.repo_id AND k.path = b.path WHERE category = 'DB_NODE' GROUP BY ALL),
c AS (SELECT DISTINCT x.repo_id, x.path AS src, lower(list_extract(string_split(regexp_replace(x.endpoint, '/+$', ''), '/'), -1)) AS part FROM ({_on(ORACLE_SQL_BODY['c8'], 'sources')}) x SEMI JOIN (SELECT * FROM k WHERE category = 'UI_NODE') u ON x.repo_id = u.repo_id AND x.path = u.path WHERE x.method = 'fetch' AND NOT starts_with(x.endpoint, 'http')),
m AS (SELECT c.repo_id, c.src, c.part, coalesce(min(CASE WHEN regexp_replace(list_extract(string_split(lg.w, '/'), -1), '\\.[^.]*$', '') = c.part THEN lg.dst END), min(lg.dst)) AS dst FROM c JOIN lg ON c.repo_id = lg.repo_id AND c.part <> '' AND contains(lg.w, c.part) GROUP BY ALL)
SELECT DISTINCT repo_id, src, dst, 'fetch' AS label FROM m UNION SELECT k.repo_id, k.path, db.dst, 'query' FROM k JOIN db ON k.repo_id = db.repo_id AND contains(k.low, db.name) WHERE category = 'LOGIC_NODE'
UNION SELECT k.repo_id, k.path, db.dst, 'direct query' FROM k JOIN db ON k.repo_id = db.repo_id AND contains(k.low, db.name) WHERE category = 'UI_NODE' AND regexp_matches(k.low, 'supabase|prisma\\.|mongoose')""")

# --- graphs -------------------------------------------------------------------

register("d1_resolve_imports", "modules", lambda m: link.import_edges(m).filter("resolved").select("repo_id", "path", "specifier", "target"), f"SELECT repo_id, path, specifier, target FROM ({ORACLE_SQL_BODY['d2']}) WHERE resolved")


def _edge_snapshots(e: DataFrame) -> DataFrame:
    rows = e.groupBy("repo_id", "src", "kind").agg(F.min("dst").alias("low"), F.max("dst").alias("high"))
    keyed = rows.select("repo_id", F.concat_ws(">", "src", "kind").alias("id"), "src", "low", "high")
    base = keyed.filter("id NOT LIKE '%7>%'").select("repo_id", "id", "src", F.col("low").alias("dst"))
    head = keyed.filter("id NOT LIKE '%3>%'").select("repo_id", "id", "src", F.col("high").alias("dst"))
    return link.node_diff(base, head, ["repo_id", "id"], ["dst", "src"]).select("repo_id", "id", "status")


register("d24_edge_diff", "edges", _edge_snapshots, """WITH r AS (SELECT repo_id, src || '>' || kind AS id, min(dst) AS low, max(dst) AS high FROM edges GROUP BY repo_id, src, kind)
SELECT repo_id, id, CASE WHEN id LIKE '%7>%' THEN 'added' WHEN id LIKE '%3>%' THEN 'deleted' WHEN low = high THEN 'unchanged' ELSE 'modified' END AS status FROM r WHERE NOT (id LIKE '%7>%' AND id LIKE '%3>%')""")
register("i1_without_portals", "edges sections nodes", lambda e, s, n: e.join(graph.portal_links(e, link.assign_section(n, s).filter("section_id IS NOT NULL")).select("repo_id", "src", "dst"), ["repo_id", "src", "dst"], "left_anti").select("repo_id", "src", "dst", "kind"), f"SELECT repo_id, src, dst, kind FROM edges e ANTI JOIN ({ORACLE_SQL_BODY['d20'].replace('WITH h AS', 'WITH h AS')}) p USING (repo_id, src, dst)")
register("i2_union_edges", "edges screens", lambda e, s: e.unionByName(navigation.nav_edges(s).withColumnRenamed("label", "kind"), allowMissingColumns=True).select("repo_id", "src", "dst", "kind"), f"SELECT repo_id, src, dst, kind FROM edges UNION ALL SELECT repo_id, src, dst, label FROM ({_NAV})")
register("f17_issues_for_node", "nodes edges", lambda n, e: graph.issues_by_node(graph.issues(n, e), e).groupBy("repo_id", "node_id", "role").agg(F.count(F.lit(1)).alias("n")), f"""WITH i AS (SELECT repo_id, node_id, 'god-class' AS kind, severity FROM ({ORACLE_SQL_BODY['f4']}) UNION SELECT repo_id, node_id, 'oversized-file', severity FROM ({ORACLE_SQL_BODY['f5']}) UNION SELECT repo_id, src, 'view-to-db', 'high' FROM ({_TYPED}) WHERE a = 'view' AND b = 'database'
UNION SELECT repo_id, src, 'missing-validation', 'medium' FROM ({ORACLE_SQL_BODY['d19']}) UNION SELECT repo_id, node_id, 'orphan', 'low' FROM ({ORACLE_SQL_BODY['d14']})),
a AS (SELECT repo_id, node_id, kind, severity, 'subject' AS role FROM i UNION SELECT i.repo_id, e.dst, i.kind, i.severity, 'impacted' FROM i JOIN edges e ON i.repo_id = e.repo_id AND i.node_id = e.src)
SELECT repo_id, node_id, role, count(*) AS n FROM a GROUP BY ALL""")
register("f19_annotation_counts", "nodes changes", lambda n, c: c.groupBy("repo_id", F.concat(F.lit("c"), F.expr("substring(node_id, 2)")).alias("node_id")).agg(F.count(F.lit(1)).alias("annotations")).join(n.select("repo_id", "node_id"), ["repo_id", "node_id"]), """SELECT n.repo_id, n.node_id, c.annotations FROM nodes n JOIN (SELECT repo_id, 'c' || node_id[2:] AS node_id, count(*) AS annotations FROM changes GROUP BY ALL) c USING (repo_id, node_id)""")
register("e6_recent_projects", "changes", lambda c: c.groupBy("repo_id").agg(F.max("ts").alias("updated")).filter("repo_id <> 'r0'").withColumn("position", F.expr("row_number() OVER (ORDER BY updated DESC, repo_id)")).select("repo_id", "position"), "SELECT repo_id, CAST(row_number() OVER (ORDER BY max(ts) DESC, repo_id) AS INTEGER) AS position FROM changes WHERE repo_id <> 'r0' GROUP BY repo_id")
register("f8_delegation_libs", "screens", lambda m: scan.delegation_libs(m), f"""SELECT repo_id, array_to_string(list_sort(list_distinct(list(lib))), ',') AS libs FROM (SELECT repo_id, unnest(regexp_extract_all(source, {_q(scan.DELEGATION)})) AS lib FROM screens) GROUP BY ALL""")
register("c17_complexity_estimate", "nodes", lambda n: n.select("repo_id", "node_id", scan.complexity_estimate(F.col("type")).alias("e")).select("repo_id", "node_id", "e.complexity", "e.level"), """SELECT repo_id, node_id, CASE WHEN type = 'validation' THEN 3 WHEN type = 'controller' THEN 5 ELSE 1 END AS complexity, CASE WHEN type = 'controller' THEN 'moderate' ELSE 'low' END AS level FROM nodes""")
register("g10_unvalidated_controllers", "nodes edges", graph.unvalidated_controllers, f"""WITH t AS (SELECT * FROM ({_TYPED}) WHERE b <> 'validation'), p AS (SELECT repo_id, dst AS node_id, 1 AS h, src || '>' || dst AS path FROM t WHERE a = 'view' AND b = 'controller'
UNION ALL SELECT x.repo_id, y.dst, 2, x.src || '>' || x.dst || '>' || y.dst FROM t x JOIN t y ON x.repo_id = y.repo_id AND x.dst = y.src WHERE x.a = 'view' AND y.b = 'controller')
SELECT repo_id, node_id, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, node_id ORDER BY h, path) AS k FROM p) WHERE k = 1""")
register("g5_deep_chains", "nodes edges", lambda n, e: graph.deep_chains(n, e, 1), """WITH RECURSIVE s AS (SELECT repo_id, src, dst FROM edges WHERE kind IN ('call', 'reference', 'query') AND src <> dst), c AS (SELECT DISTINCT repo_id, src AS a, dst AS b FROM s WHERE src LIKE 's%' UNION SELECT c.repo_id, c.a, s.dst FROM c JOIN s ON s.repo_id = c.repo_id AND s.src = c.b),
bad AS (SELECT DISTINCT x.repo_id, x.a AS node_id FROM c x WHERE EXISTS (SELECT 1 FROM c y WHERE y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.b) OR x.a = x.b),
w AS (SELECT repo_id, node_id, node_id AS at, 0 AS d FROM nodes n ANTI JOIN bad USING (repo_id, node_id) UNION SELECT w.repo_id, w.node_id, s.dst, w.d + 1 FROM w JOIN s ON s.repo_id = w.repo_id AND s.src = w.at WHERE w.d < 60)
SELECT repo_id, node_id, CAST(max(d) AS INTEGER) AS depth FROM w GROUP BY repo_id, node_id HAVING max(d) > 1""")


def _path_pairs(n: DataFrame, e: DataFrame) -> DataFrame:
    asked = n.filter("type = 'view' AND cast(substring(node_id, 2) AS BIGINT) % 50 = 0").select("repo_id", F.col("node_id").alias("origin"))
    two = e.select("repo_id", F.col("src").alias("origin"), F.col("dst").alias("mid")).join(asked, ["repo_id", "origin"]).join(e.select("repo_id", F.col("src").alias("mid"), F.col("dst").alias("target")), ["repo_id", "mid"])
    return two.select("repo_id", "origin", "target").distinct()


register("g3_all_paths", "nodes edges", lambda n, e: graph.all_paths(_path_pairs(n, e), e, depth=6), """WITH RECURSIVE s AS (SELECT DISTINCT repo_id, src, dst FROM edges), q AS (SELECT DISTINCT n.repo_id, n.node_id AS origin, y.dst AS target FROM nodes n JOIN s x ON x.repo_id = n.repo_id AND x.src = n.node_id JOIN s y ON y.repo_id = x.repo_id AND y.src = x.dst WHERE n.type = 'view' AND CAST(n.node_id[2:] AS BIGINT) % 50 = 0),
w AS (SELECT DISTINCT repo_id, origin, origin AS at, [origin] AS p FROM q UNION ALL SELECT w.repo_id, w.origin, s.dst, list_append(w.p, s.dst) FROM w JOIN s ON s.repo_id = w.repo_id AND s.src = w.at WHERE len(w.p) <= 6 AND NOT list_contains(w.p, s.dst))
SELECT repo_id, origin, target, path FROM (SELECT q.repo_id, q.origin, q.target, array_to_string(w.p, '>') AS path, row_number() OVER (PARTITION BY q.repo_id, q.origin, q.target ORDER BY len(w.p), w.p) AS k FROM q JOIN w ON q.repo_id = w.repo_id AND q.origin = w.origin AND q.target = w.at AND len(w.p) > 1) WHERE k <= 10""")
_refs = "cast(substring(node_id, 2) AS BIGINT) % 50 = 0 AND type = 'validation'"
register("g24_connected_set", "nodes edges", lambda n, e: graph.connected_set(n.filter(_refs), n.filter("type = 'validation'"), e.filter("kind = 'reference'").join(n.select("repo_id", F.col("node_id").alias("dst")), ["repo_id", "dst"], "left_semi")), """WITH RECURSIVE u AS (SELECT e.repo_id, e.src, e.dst FROM edges e SEMI JOIN nodes n ON e.repo_id = n.repo_id AND e.dst = n.node_id WHERE kind = 'reference'), b AS (SELECT repo_id, src AS x, dst AS y FROM u UNION SELECT repo_id, dst, src FROM u),
r AS (SELECT repo_id, node_id AS origin, node_id FROM nodes WHERE type = 'validation' AND CAST(node_id[2:] AS BIGINT) % 50 = 0 UNION SELECT r.repo_id, r.origin, b.y FROM r JOIN b ON b.repo_id = r.repo_id AND b.x = r.node_id) SELECT * FROM r""")
register("g18_dead_ends", "nodes edges", graph.dead_ends, """WITH c AS (SELECT repo_id, col, lag(col) OVER w AS b, lead(col) OVER w AS a FROM (SELECT DISTINCT repo_id, CAST(trunc(x) AS BIGINT) AS col FROM nodes) WINDOW w AS (PARTITION BY repo_id ORDER BY col)), n AS (SELECT repo_id, node_id, CAST(trunc(x) AS BIGINT) AS col FROM nodes)
SELECT n.repo_id, n.node_id, 'in' AS lacks, c.b AS nearest FROM n JOIN c USING (repo_id, col) ANTI JOIN (SELECT DISTINCT repo_id, dst AS node_id FROM edges) e ON n.repo_id = e.repo_id AND n.node_id = e.node_id
UNION ALL SELECT n.repo_id, n.node_id, 'out', c.a FROM n JOIN c USING (repo_id, col) ANTI JOIN (SELECT DISTINCT repo_id, src AS node_id FROM edges) e ON n.repo_id = e.repo_id AND n.node_id = e.node_id""")
_homes = lambda n: n.select("repo_id", "node_id", F.col("type").alias("section_id"))
register("g17_bridges", "nodes edges", lambda n, e: graph.bridges(e, _homes(n)), f"""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, a, b ORDER BY src, dst, kind) AS k FROM ({_TYPED}) WHERE a <> b) WHERE k = 1)
SELECT repo_id, src, dst, kind FROM edges ANTI JOIN f USING (repo_id, src, dst, kind) UNION ALL SELECT repo_id, src, 'bridge:' || a || ':' || b, 'bridge' FROM f UNION ALL SELECT repo_id, 'bridge:' || a || ':' || b, dst, 'bridge' FROM f""")


def _doors(n: DataFrame) -> DataFrame:
    """Orders' routes as sign-in routes and customers' as pages of a role, by their numbers."""
    k = F.expr("cast(substring(node_id, 2) AS BIGINT)")
    role = F.when(k % 3 == 0, "/manager/").when(k % 3 == 1, "/customer/").otherwise("/staff/")
    return n.withColumn("label", F.when(F.col("type") == "controller", F.concat(F.when(k % 2 == 0, "/api/auth/login/").otherwise("/api/"), k)).when(F.col("type") == "view", F.concat(role, k)).otherwise(F.col("label")))


register("d21_role_gateways", "nodes edges", lambda n, e: graph.role_gateways(_doors(n), e.select("repo_id", F.concat(F.lit("o"), F.expr("cast(cast(substring(src, 2) AS BIGINT) * 2 AS STRING)")).alias("src"), F.col("src").alias("dst")).filter("dst LIKE 'c%'").unionByName(e.filter("src LIKE 'c%'").select("repo_id", F.concat(F.lit("o"), F.expr("cast(cast(substring(src, 2) AS BIGINT) * 2 + 20 AS STRING)")).alias("src"), F.col("src").alias("dst")))), """WITH e2 AS (SELECT repo_id, 'o' || CAST(CAST(src[2:] AS BIGINT) * 2 AS VARCHAR) AS src, src AS dst FROM edges WHERE src LIKE 'c%' UNION SELECT repo_id, 'o' || CAST(CAST(src[2:] AS BIGINT) * 2 + 20 AS VARCHAR), src FROM edges WHERE src LIKE 'c%')
SELECT e.repo_id, e.src AS node_id, array_to_string(list_sort(list_distinct(list(CASE CAST(e.dst[2:] AS BIGINT) % 3 WHEN 0 THEN 'manager' WHEN 1 THEN 'customer' ELSE 'staff' END))), ',') AS roles FROM e2 e JOIN nodes n ON n.repo_id = e.repo_id AND n.node_id = e.src AND n.type = 'controller' AND CAST(n.node_id[2:] AS BIGINT) % 2 = 0
JOIN nodes v ON v.repo_id = e.repo_id AND v.node_id = e.dst AND v.type = 'view' GROUP BY ALL HAVING count(DISTINCT CAST(e.dst[2:] AS BIGINT) % 3) >= 2""")
register("g22_validate_graph", "nodes edges", lambda n, e: graph.validate_graph(n, e, F.col("type") == "database", (F.col("type") == "view") & F.col("label").contains("machinery"), 1).groupBy("repo_id", "kind", "severity").agg(F.count(F.lit(1)).alias("n")), f"""SELECT repo_id, kind, severity, count(*) AS n FROM (SELECT repo_id, 'circular-dependency' AS kind, 'error' AS severity FROM ({ORACLE_SQL_BODY['g4']}) UNION ALL SELECT repo_id, 'deep-call-chain', 'warning' FROM ({ORACLE_SQL_BODY['g5']})
UNION ALL SELECT repo_id, 'missing-auth', 'error' FROM ({ORACLE_SQL_BODY['g7']}) UNION ALL SELECT repo_id, 'missing-validation', 'warning' FROM ({ORACLE_SQL_BODY['g8']})) GROUP BY ALL""")


def _billing(changes: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_id") % 5 == 0, "checkout.session.completed").when(F.col("event_id") % 5 == 1, "customer.subscription.updated").when(F.col("event_id") % 5 == 2, "customer.subscription.deleted").when(F.col("event_id") % 5 == 3, "invoice.paid").otherwise("other")
    status = F.when(F.col("change") == "added", "trialing").when(F.col("change") == "deleted", "past_due").otherwise("unpaid")
    return changes.select(F.col("node_id").alias("user_id"), kind.alias("kind"), status.alias("status"), "ts", "event_id")


register("k4_subscription_state", "changes", lambda c: feed.subscription_state(_billing(c)).select("user_id", "tier", "status"), """WITH b AS (SELECT node_id AS user_id, ts, event_id, event_id % 5 AS k, CASE change WHEN 'added' THEN 'active' WHEN 'deleted' THEN 'past_due' ELSE 'canceled' END AS s FROM changes WHERE event_id % 5 < 4),
r AS (SELECT user_id, ts, event_id, CASE k WHEN 1 THEN s WHEN 2 THEN 'canceled' ELSE 'active' END AS status, CASE k WHEN 0 THEN 'pro' WHEN 1 THEN CASE WHEN s = 'canceled' THEN 'free' ELSE 'pro' END WHEN 2 THEN 'free' END AS tier FROM b)
SELECT user_id, max_by(tier, (ts, event_id)) FILTER (tier IS NOT NULL) AS tier, max_by(status, (ts, event_id)) AS status FROM r GROUP BY user_id""")

# --- deployment, snippets, keys -------------------------------------------------

_has_res = lambda path, text: f"regexp_matches(lower(path), {_q(path)}) AND regexp_matches(source, {_q(text)})"
_RES = " UNION ".join(f"SELECT repo_id, path, '{kind}' AS type, '{provider}' AS provider, '{name}' AS name FROM sources WHERE {_has_res(path, text)}" for path, text, kind, provider, name in infra.RESOURCES)
_SUPABASE = f"(contains(lower(path), 'supabase') OR contains(source, '{infra.SUPABASE_CLIENT}'))"
register("c29_infra_resources", "sources", infra.infra_resources, f"""{_RES}
UNION SELECT repo_id, path, 'storage', 'supabase', 'Supabase Storage' FROM sources WHERE {_SUPABASE} AND regexp_matches(source, {_q(infra.SUPABASE_STORAGE)})
UNION SELECT repo_id, path, 'function', 'supabase', 'Supabase Edge Function' FROM sources WHERE {_SUPABASE} AND regexp_matches(lower(path), '/functions/.*\\.ts$')
UNION SELECT repo_id, path, 'storage', 'aws', 'S3: ' || unnest(regexp_extract_all(source, {_q(infra.BUCKET)}, 1)) FROM sources WHERE regexp_matches(lower(path), {_q(infra.AWS_FILES)})""")
_TARGET_CASE = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(lower(path), {_q(t[0])}) THEN '{t[i]}'" for t in infra.TARGETS) + " END"
register("c29_deployment_targets", "sources", infra.deployment_targets, f"""SELECT repo_id, path, provider, name FROM (
SELECT repo_id, path, {_TARGET_CASE(1)} AS provider, {_TARGET_CASE(2)} AS name, row_number() OVER (PARTITION BY repo_id ORDER BY NOT contains(lower(path), 'vercel.json'), path) AS k
FROM sources WHERE {_TARGET_CASE(1)} IS NOT NULL) WHERE k = 1""")


def _snippet_nodes(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each file once, and as a node: of the table that it creates, of its validation, of its route, or a view."""
    once = keep_first(m, ["repo_id", "path"], ["source"])
    table = F.nullif(F.regexp_extract("source", scan.CREATE_TABLE, 1), F.lit(""))
    kind = F.when(table.isNotNull(), "database").when(F.col("path").contains("/api/"), "controller").when(F.col("source").rlike(r"\b(z|yup)\.object"), "validation").otherwise("view")
    return once, once.select("repo_id", "path", kind.alias("type"), F.coalesce(table, "path").alias("label"))


_part = lambda p: f"nullif(regexp_extract(source, {_q(p)}), '')"
_table_part = lambda a, b: f"nullif(regexp_extract(source, {_q(a)} || label || {_q(b)}), '')"
register("c33_code_snippet", "sources", lambda m: infra.snippets(*_snippet_nodes(m)), f"""WITH f AS (SELECT repo_id, path, min(source) AS source FROM sources GROUP BY ALL),
n AS (SELECT *, regexp_extract(source, {_q(scan.CREATE_TABLE)}, 1) AS made FROM f), t AS (SELECT repo_id, path, source, CASE WHEN made <> '' THEN 'database' WHEN contains(path, '/api/') THEN 'controller' WHEN regexp_matches(source, '\\b(z|yup)\\.object') THEN 'validation' ELSE 'view' END AS type,
  CASE WHEN made <> '' THEN made ELSE path END AS label FROM n)
SELECT repo_id, path, type, label, coalesce(CASE type WHEN 'controller' THEN coalesce({_part(infra.METHOD_PART)}, {_part(infra.HANDLER_PART)}) WHEN 'validation' THEN coalesce({_part(infra.ZOD_PART)}, {_part(infra.YUP_PART)})
  WHEN 'database' THEN coalesce({', '.join(_table_part(a, b) for a, b in infra.TABLE_PARTS)}) END,
  CASE WHEN length(source) > {infra.SNIPPET} THEN left(source, {infra.SNIPPET}) || chr(10) || chr(10) || '// ... (truncated)' ELSE source END) AS snippet FROM t""")
_catalog = lambda m: schema.schema_catalog(keep_first(m.filter(F.col("path").endswith(".sql")), ["repo_id", "path"], ["source"]))
_LINES = f"""SELECT repo_id, path, regexp_extract(source, {_q(scan.CREATE_TABLE)}, 1) AS table_name, unnest(string_split(source, chr(10))) AS line FROM (SELECT repo_id, path, min(source) AS source FROM modules WHERE path LIKE '%.sql' GROUP BY ALL)"""
_REF = "(\\w+) \\w+.* REFERENCES (\\w+)\\((\\w+)\\)"
register("f16_cardinality", "modules", lambda m: _catalog(m).filter("ref_table IS NOT NULL").select("repo_id", "path", "table_name", "name", schema.cardinality(F.col("is_unique")).alias("cardinality")), f"""
SELECT repo_id, path, table_name, regexp_extract(line, '{_REF}', 1) AS name, CASE WHEN contains(line, 'UNIQUE') THEN 'one-to-one' ELSE 'one-to-many' END AS cardinality FROM ({_LINES}) WHERE regexp_matches(line, '{_REF}')""")


def _reference_map(m: DataFrame) -> DataFrame:
    found = written(_catalog(m))
    return schema.reference_map(schema.foreign_keys(found), found)


register("d28_fk_reference_map", "modules", _reference_map, f"""WITH l AS ({_LINES}), k AS (SELECT DISTINCT repo_id, table_name FROM l)
SELECT repo_id, table_name, regexp_extract(line, '{_REF}', 1) AS name, min(regexp_extract(line, '{_REF}', 2) || '.' || regexp_extract(line, '{_REF}', 3)) AS ref
FROM l SEMI JOIN k ON k.repo_id = l.repo_id AND k.table_name = regexp_extract(line, '{_REF}', 2) WHERE regexp_matches(line, '{_REF}') GROUP BY ALL""")

# --- journeys -----------------------------------------------------------------


def _signals(files: DataFrame) -> DataFrame:
    """Journey signals with their lists as texts."""
    stores = F.transform("stores", lambda s: F.concat_ws("|", s.trigger, s.label, s.edge))
    return journey.journey_signals(files).withColumns({"decisions": F.array_join("decisions", ","), "services": F.array_join("services", ","), "stores": F.array_join(stores, ",")})


def _signal_sql(in_path: str | None, in_text: str | None, packages: list[str]) -> str:
    signs = [f"regexp_matches(path, {_q(in_path)})"] if in_path else []
    signs += [f"regexp_matches(source, {_q(in_text)})"] if in_text else []
    signs += [f"list_has_any(packages, {packages})"] if packages else []
    return f"({' OR '.join(signs)})"


_PACKAGES = " || ".join(f"coalesce(json_keys(CASE WHEN path LIKE '%package.json' AND json_valid(raw) THEN raw::JSON END, '$.{k}'), [])" for k in ("dependencies", "devDependencies"))
_CRUD_CASE = f"""CASE WHEN NOT api THEN 'API' WHEN {_HAS['READ']} AND NOT {_HAS['CREATE']} AND NOT {_HAS['UPDATE']} THEN 'READ' WHEN {_HAS['UPDATE']} AND NOT {_HAS['CREATE']} THEN 'UPDATE'
  WHEN {_HAS['CREATE']} THEN 'CREATE' WHEN {_HAS['DELETE']} AND NOT {_HAS['READ']} THEN 'DELETE' {_VERB_CASES} ELSE 'API' END"""
_LAYOUT = f"""CASE WHEN regexp_matches(path, {_q(journey.LAYOUT)}) THEN list_transform(list_filter(list_transform(regexp_extract_all(raw, {_q(journey.LAYOUT_IMPORT)}, 1),
  lambda x: regexp_replace(regexp_replace(x, '^\\./', ''), '^\\.\\./', '')), lambda x: NOT regexp_matches(x, {_q(journey.NO_ROUTES)})), lambda x: '/' || x) ELSE [] END"""
_PAGE = [f"regexp_extract(path, {_q(p)}, 1)" for p in (journey.APP_PAGE, journey.PAGES_PAGE)]
_STORES = ", ".join(
    f"CASE WHEN {f"contains(words, '{subject}')" if subject else 'auth'} AND (regexp_matches(words, '{action}'){f" OR crud = '{crud}'" if crud else ''}) THEN '{trigger}|{label}|{edge}' END"
    for trigger, label, edge, subject, action, crud in journey.STORES
)
register("c26_journey_signals", "sources", _signals, f"""WITH m AS (SELECT DISTINCT repo_id, path, coalesce(source, '') AS raw, lower(coalesce(source, '')) AS source FROM sources),
p AS (SELECT *, {_PACKAGES} AS packages, source || chr(10) || lower(path) AS words FROM m),
f AS (SELECT *, {', '.join(f'{_signal_sql(*signs)} AS {name}' for name, signs in journey.SIGNALS.items())}, {_LAYOUT} AS layout,
  list_sort(list_filter([{', '.join(f"CASE WHEN regexp_matches(source, {_q(p)}) THEN '{k}' END" for k, p in journey.SERVICES.items())}], lambda x: x IS NOT NULL)) AS services FROM p),
c AS (SELECT *, {_CRUD_CASE} AS crud FROM f), s AS (SELECT *, list_filter([{_STORES}], lambda x: x IS NOT NULL) AS found FROM c)
SELECT DISTINCT repo_id, path, {', '.join(journey.SIGNALS)}, len(services) > 0 AS external_service, crud,
  CASE WHEN {_PAGE[0]} <> '' THEN '/' || {_PAGE[0]} WHEN {_PAGE[1]} <> '' AND NOT regexp_matches({_PAGE[1]}, {_q(journey.NO_PAGES)}) THEN '/' || regexp_replace({_PAGE[1]}, '[\\[\\]]', ':', 'g') ELSE layout[1] END AS route,
  array_to_string(list_sort(list_distinct({' || '.join(f'regexp_extract_all(source, {_q(p)}, 1)' for p in journey.LEADS)} || layout)), ',') AS decisions, array_to_string(services, ',') AS services,
  CASE WHEN len(found) = 0 AND crud = 'CREATE' THEN '{'|'.join(journey.PLAIN_STORE)}' ELSE array_to_string(found, ',') END AS stores FROM s""")


def _parsed(files: DataFrame) -> DataFrame:
    """Nodes, edges and their counts in one table."""
    nodes, edges = parse.deterministic_parse(files)
    counts = parse.parse_stats(nodes, edges)
    parts = [nodes.select("repo_id", "type", "key", "label"), edges.select("repo_id", "type", "src", "dst"), counts.select("repo_id", "type", F.lit("count"), F.col("n").cast("string"))]
    return parts[0].union(parts[1]).union(parts[2])


_ROUTE_PAGES = _on(ORACLE_SQL_BODY["b7"], "sources").replace("FROM screens", "FROM sources")
_API = " , ".join(f"nullif(regexp_extract(path, {_q(p)}, 1), '')" for p in (parse.APP_API, parse.PAGES_API))
register("g23_deterministic_parse", "sources", _parsed, f"""WITH r AS ({_ROUTE_PAGES}), v AS (SELECT repo_id, path, max(kind) AS kind FROM ({_on(ORACLE_SQL_BODY['c6'], 'sources')}) WHERE regexp_matches(path, {_q(parse.PAGE_FOLDERS)}) GROUP BY ALL),
l AS ({_on(_LINES, 'sources')}), c AS (SELECT DISTINCT repo_id, '/' || regexp_replace(coalesce({_API}), '\\[\\[?\\w+\\]?\\]', ':param', 'g') AS route FROM sources WHERE coalesce({_API}) IS NOT NULL),
p AS (SELECT repo_id, 'route' AS type, route AS key, label FROM r UNION ALL SELECT repo_id, 'controller', route, route FROM c UNION ALL SELECT repo_id, 'validation', path, kind FROM v
  UNION ALL SELECT DISTINCT repo_id, 'table', table_name, table_name FROM l UNION ALL SELECT repo_id, 'validates', route, path FROM r JOIN v USING (repo_id, path)
  UNION ALL SELECT DISTINCT repo_id, CASE WHEN contains(line, 'UNIQUE') THEN 'one-to-one' ELSE 'one-to-many' END, table_name, regexp_extract(line, '{_REF}', 2) FROM l WHERE regexp_matches(line, '{_REF}'))
SELECT * FROM p UNION ALL SELECT repo_id, type, 'count', CAST(count(*) AS VARCHAR) FROM p GROUP BY ALL""")
