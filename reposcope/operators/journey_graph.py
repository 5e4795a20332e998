"""The journey of a user through a repository: typed nodes of its files, woven into one graph.

Files are scanned once (`journey.signal_rows`); what is joined and sorted from
there on are nodes. Files come in the order of their paths. A repository's
first and last node of each kind are minima and maxima over its nodes, chains
are neighbours in a distributed sort, so no repository is the work of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions.text import keep_first, union
from reposcope.operators import journey
from reposcope.operators.code import model_names
from reposcope.operators.match import contains_join
from reposcope.operators.sequence import following, ranked
from reposcope.sources.tables import written

REPO = "repo_id"
# Column and shape of each type of node.
TYPES = {
    "start": (0, "pill"), "page": (4, "pill"), "auth": (2, "diamond"), "validation": (3, "diamond"), "decision": (4, "diamond"), "action": (5, "rectangle"),
    "database": (6, "cylinder"), "logout": (7, "pill"), "end": (8, "pill"), "middleware": (2, "hexagon"), "external_service": (5, "parallelogram"),
    "service": (5, "rectangle"), "error_handler": (6, "diamond"), "cache": (5, "hexagon"), "bridge": (0, "circle"),
}
# Packages of note, and the nodes of those whose name contains a word.
PACKAGES = [
    "stripe", "@supabase/supabase-js", "prisma", "@prisma/client", "mongoose", "redis", "ioredis", "@sendgrid/mail", "openai", "aws-sdk", "@aws-sdk/client-s3", "firebase", "twilio", "cloudinary",
    "@octokit/rest", "winston", "pino", "sentry", "next-auth", "@auth/core", "express", "fastify", "koa", "react-query", "@tanstack/react-query", "swr", "bull", "bullmq", "node-cron",
]
DATABASES = [("supabase", "DB: Supabase"), ("prisma", "DB: Prisma"), ("mongoose", "DB: MongoDB")]
CACHES = [("redis", "Cache: Redis"), ("react-query", "Cache: React Query"), ("swr", "Cache: React Query")]
EXTERNALS = [
    ("stripe", "Stripe"), ("openai", "OpenAI"), ("@sendgrid/mail", "SendGrid"), ("twilio", "Twilio"), ("cloudinary", "Cloudinary"), ("@octokit/rest", "GitHub API"), ("aws-sdk", "AWS"),
    ("@aws-sdk/client-s3", "AWS S3"), ("firebase", "Firebase"), ("sentry", "Sentry"),
]
SERVICES = [("bull", "Service: BullMQ"), ("node-cron", "Service: Cron")]
OAUTH, OAUTH_PACKAGES = "Auth: OAuth", ["next-auth", "@auth/core"]
# Sections of files by their signals (the first that fits), of nodes without a file by their type, and their labels.
FILE_SECTIONS = [
    ("logout", "exit"), ("auth", "auth"), ("landing", "entry"), ("database", "data"), ("error_handler", "errors"), ("external_service", "services"), ("background_service", "services"), ("cache", "services"),
    ("middleware", "services"), ("api", "core"),
]
TYPE_SECTIONS = {
    "start": "entry", "end": "entry", "logout": "exit", "auth": "auth", "database": "data", "error_handler": "errors", "middleware": "services", "external_service": "services", "service": "services",
    "cache": "services", "action": "core", "page": "entry", "decision": "entry",
}
SECTION_LABELS = {"entry": "Entry", "auth": "Auth", "core": "Core API", "services": "Services", "data": "Data Layer", "errors": "Error Handling", "exit": "Session Exit", "misc": "Miscellaneous"}
# Labels of edges that only converge; the other edges make the tree.
CONVERGING = [
    "select", "call external", "enqueue", "catch error", "check cache", "cache miss", "log", "save project", "save post", "save comment", "save file", "save order", "save data", "store profile", "update record",
]
CONVERGING_CRUD = r"^(CREATE|READ|UPDATE|DELETE)\s*→"
#: Phases of a repository's nodes: its beginning, its files, the service bus, its end, bridges.
BEGINNING, FILES, BUS, END, BRIDGES = range(5)
#: Parts into which the actions of a list of models are dealt.
PIECES = 32
#: What a node may carry besides its type, label and whether every file has one of its own.
_MORE = {"crud": "string", "models": "array<string>", "targets": "array<string>", "trigger": "string", "edge": "string"}
_FIELDS = ", ".join(f"{k}: {t}" for k, t in {"type": "string", "label": "string", "own": "boolean", **_MORE}.items())


def _nulls(more: dict[str, Column] | None = None) -> list[Column]:
    return [(more or {}).get(k, F.lit(None).cast(t)).alias(k) for k, t in _MORE.items()]


# --- nodes ----------------------------------------------------------------------


def _node(kind: str, label: Column | str, own: bool, **more: Column) -> Column:
    """A node; `own` if every file has one of its own, else equal labels are one node."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.struct(F.lit(kind).alias("type"), label.alias("label"), F.lit(own).alias("own"), *_nulls(more))


def _first(dep: Column, table: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(F.contains(dep, F.lit(word)), label) for word, label in table])


def _package_nodes(dep: Column) -> Column:
    """The nodes that a package stands for."""
    pick = lambda kind, label, own=False: F.when(label.isNotNull(), _node(kind, label, own))
    outside = [pick("external_service", F.when(F.contains(dep, F.lit(word)), F.lit(f"External: {label}"))) for word, label in EXTERNALS]
    signs_in = F.when(F.array_contains(F.array(*[F.contains(dep, F.lit(p)) for p in OAUTH_PACKAGES]), True), F.lit(OAUTH))
    return F.array_compact(F.array(pick("database", _first(dep, DATABASES)), pick("cache", _first(dep, CACHES)), *outside, pick("auth", signs_in, True), pick("service", _first(dep, SERVICES))))


def node_candidates(files: DataFrame) -> DataFrame:
    """(repo_id, path, place, section, node fields): what each file would add to the graph, in order."""
    rows = journey.signal_rows(files).withColumn("models", model_names(F.col("t")))
    f = F.col
    stem = lambda otherwise: F.coalesce(F.nullif(F.regexp_replace(F.substring_index("path", "/", -1), r"\.\w+$", ""), F.lit("")), F.lit(otherwise))
    named = lambda said, otherwise: F.concat(F.lit(said), stem(otherwise))
    when = lambda ask, made: F.when(ask, F.array(made)).otherwise(F.array().cast(f"array<struct<{_FIELDS}>>"))
    notable = F.filter("packages", lambda d: F.array_contains(F.array(*[F.contains(d, F.lit(p)) for p in PACKAGES]), True))
    routed = f("route").isNotNull()
    pieces = F.concat(
        when(f("auth"), _node("auth", F.coalesce(F.concat(F.lit("Auth: "), "route"), F.lit("Auth Login")), True)),
        when(f("logout"), _node("logout", "Logout", True)),
        when(f("validation"), _node("validation", named("Validate: ", "validate"), True)),
        when((F.size("decisions") > 0) & routed, _node("decision", F.concat(F.lit("Choose: "), "route"), True, targets=f("decisions"))),
        when(f("api"), _node("action", F.concat("crud", F.lit(": "), F.coalesce("route", stem("API Action"))), True, crud=f("crud"), models=f("models"))),
        F.flatten(F.transform(notable, _package_nodes)),
        when(f("middleware"), _node("middleware", named("Auth Guard: ", "middleware"), False)),
        F.transform("services", lambda s: _node("external_service", F.concat(F.lit("External: "), F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2))), False)),
        when(f("background_service"), _node("service", named("Service: ", "service"), False)),
        when(f("error_handler"), _node("error_handler", named("Error Handler: ", "error"), False)),
        when(f("cache"), _node("cache", named("Cache: ", "cache"), False)),
        F.transform("stores", lambda s: _node("database", s.label, False, trigger=s.trigger, edge=s.edge)),
        when(f("database") & ~f("api"), _node("database", named("DB: ", "Database"), False)),
        when(routed & ~f("landing") & ~f("auth") & ~f("logout") & ~f("api"), _node("page", f("route"), False)),
    )
    section = F.coalesce(*[F.when(f(sign), name) for sign, name in FILE_SECTIONS], F.when(routed, "entry"), F.lit("misc"))
    each = rows.select(REPO, "path", section.alias("section"), F.posexplode(pieces).alias("place", "n"))
    return each.select(REPO, "path", "place", "section", "n.*").distinct()


def journey_nodes(files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Nodes without bridges and rows: repo_id, node_id, type, label, path, section, phase, place, and what edges need.

    Of equal labels of a type the first counts, but sign-ins, sign-outs,
    validations, decisions and actions are one for each file. An OAuth package
    makes a sign-in only where none comes before it. Each repository of `files`
    and of `repos` (repo_id) has a start, a landing page and an end.
    """
    every = written(node_candidates(files))
    first_auth = every.filter("type = 'auth'").groupBy(REPO).agg(F.min(F.struct("path", "place")).alias("first_auth"))
    every = every.join(first_auth, REPO, "left").filter((F.col("type") != "auth") | (F.col("label") != OAUTH) | (F.struct("path", "place") == F.col("first_auth"))).drop("first_auth")
    once = keep_first(every.withColumn("whose", F.when(F.col("own"), F.col("path")).otherwise("")), [REPO, "type", "label", "whose"], ["path", "place"])
    kept = once.select(REPO, F.concat_ws(":", "type", F.when(F.col("own"), F.concat_ws("@", "label", "path")).otherwise(F.col("label"))).alias("node_id"), "type", "label", "path", "section", F.lit(FILES).alias("phase"), "place", "crud", "models", "targets", "trigger", "edge")
    known = files.select(REPO).distinct()
    known = known.unionByName(repos.select(REPO)).distinct() if repos is not None else known
    counts = kept.filter("type IN ('service', 'database')").groupBy(REPO).agg(F.count_if(F.col("type") == "service").alias("services"), F.count_if(F.col("type") == "database").alias("databases"))
    bus = counts.filter("services > 1 AND databases > 0").select(REPO)
    return union([kept, _fixed(known, "start", "Start", BEGINNING, 0), _fixed(known, "page", "Landing Page", BEGINNING, 1), _fixed(bus, "service", "Service Bus", BUS, 0), _fixed(known, "end", "Loop", END, 0)])


def _fixed(repos: DataFrame, kind: str, label: str, phase: int, place: int) -> DataFrame:
    section = F.lit(None).cast("string").alias("section")
    return repos.select(REPO, F.lit(f"{kind}::{label}").alias("node_id"), F.lit(kind).alias("type"), F.lit(label).alias("label"), F.lit("").alias("path"), section, F.lit(phase).alias("phase"), F.lit(place).alias("place"), *_nulls())


START, LANDING, SERVICE_BUS, LOOP = "start::Start", "page::Landing Page", "service::Service Bus", "end::Loop"


# --- edges ----------------------------------------------------------------------


def anchors(nodes: DataFrame) -> DataFrame:
    """One row per repository: the first and last node of each type among those of files, and of decisions and pages as one walk."""
    mine = nodes.filter(F.col("phase") == FILES).withColumn("order", F.struct("path", "place", "node_id"))
    walk = nodes.filter((F.col("phase") == FILES) & F.col("type").isin("decision", "page")).withColumn("order", F.struct(F.col("type") == "page", "path", "place", "node_id"))
    of = lambda pick, ask: pick(F.when(ask, F.col("order"))).getField("node_id")
    kinds = ["auth", "logout", "validation", "action", "database", "page", "middleware", "error_handler", "cache"]
    parts = [of(f, F.col("type") == k).alias(f"{n}_{k}") for k in kinds for n, f in (("first", F.min), ("last", F.max))]
    parts += [of(F.min, (F.col("type") == "action") & (F.col("crud") == c)).alias(f"first_{c}") for c in ("CREATE", "UPDATE")]
    ends = walk.groupBy(REPO).agg(F.min("order").getField("node_id").alias("first_walk"), F.max("order").getField("node_id").alias("last_walk"))
    bus = nodes.filter(F.col("phase") == BUS).select(REPO, F.lit(True).alias("bus"))
    return nodes.select(REPO).distinct().join(mine.groupBy(REPO).agg(*parts), REPO, "left").join(ends, REPO, "left").join(bus, REPO, "left")


def _last(a: Column, *stages: str) -> Column:
    """The node that the journey has come to: that of the last stage that a repository has."""
    return F.coalesce(*[F.col(s) for s in reversed(stages)], a)


def woven(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges between nodes: (repo_id, src, dst, kind, stage, path, place, sub), in the order of stage and the rest, of equal edges the first; actions and what they use.

    Each action leads to every database that its models name, which are more edges than there are nodes. They stay
    apart as actions (repo_id, models, node_id, crud, path, place) and databases of lists of models (repo_id, models, dst,
    model, dst_order); `uses` joins them. No other edge is equal to one of them.
    """
    marks = written(anchors(nodes))
    mine = nodes.filter(F.col("phase") == FILES)
    with_marks = mine.join(marks, REPO)
    c, none = F.col, F.lit(None).cast("string")
    parts: list[DataFrame] = []

    def add(rows: DataFrame, stage: int | Column, src: Column, dst: Column, kind: Column | str, sub: Column | int = 0) -> None:
        of_file = "path" in rows.columns
        kind, sub = F.lit(kind) if isinstance(kind, str) else kind, F.lit(sub).cast("string") if isinstance(sub, int) else sub
        parts.append(rows.select(REPO, src.alias("src"), dst.alias("dst"), kind.alias("kind"), (stage if isinstance(stage, Column) else F.lit(stage * 10)).alias("stage"), (c("path") if of_file else F.lit("")).alias("path"), (c("place") if of_file else F.lit(0)).alias("place"), sub.alias("sub")))

    def each(kind: str) -> DataFrame:
        return with_marks.filter(c("type") == kind)

    def chain(kind: str, stage: int, label: str) -> None:
        after = following(mine.filter(c("type") == kind), [REPO], ["path", "place"], "node_id", "dst")
        add(after.join(mine.select(REPO, "node_id", "path", "place"), [REPO, "node_id"]), stage, c("node_id"), c("dst"), label)

    add(marks, 1, F.lit(START), F.lit(LANDING), "open app")
    add(each("auth"), 2, F.lit(LANDING), c("node_id"), "needs login")
    add(marks.filter("first_auth IS NULL"), 2, F.lit(LANDING), c("first_page"), "browse")
    # a validation belongs to the sign-in of its file, or else to the first one
    own = mine.filter("type = 'auth'").groupBy(REPO, "path").agg(F.min(F.struct("place", "node_id")).getField("node_id").alias("own_auth"))
    checked = each("validation").join(own, [REPO, "path"], "left").withColumn("asks", F.coalesce("own_auth", "first_auth")).filter("asks IS NOT NULL")
    add(checked, 3, c("asks"), c("node_id"), "check", 0)
    add(checked, 3, c("node_id"), c("asks"), "fail → retry", 1)
    entered = F.coalesce(F.when(c("first_auth").isNotNull(), F.coalesce("last_validation", "last_auth")), c("first_page"), F.lit(LANDING))
    add(marks, 4, entered, c("first_walk"), "browse")
    targets = mine.filter("type = 'decision'").select(REPO, "node_id", "path", "place", F.posexplode("targets").alias("sub", "label"))
    pages = mine.filter("type = 'page'").select(REPO, "label", c("node_id").alias("dst"))
    led = written(targets.join(pages, [REPO, "label"]))
    add(led, 5, c("node_id"), c("dst"), "yes", F.lpad(c("sub").cast("string"), 9, "0"))
    walk = mine.filter(c("type").isin("decision", "page")).withColumn("paged", (c("type") == "page").cast("int"))
    unbranched = walk.join(led.select(REPO, c("dst").alias("node_id")).distinct(), [REPO, "node_id"], "left_anti")
    after = following(unbranched, [REPO], ["paged", "path", "place"], "node_id", "dst").join(walk.select(REPO, "node_id", "paged", "path", "place"), [REPO, "node_id"])
    add(after, 60 + c("paged"), c("node_id"), c("dst"), "navigate")
    add(marks, 7, c("last_walk"), c("first_action"), "flow")
    for kind, sub in (("decision", 0), ("page", 1)):
        add(each(kind), 8, c("node_id"), c("first_action"), "select", sub)
    chain("action", 9, "next")
    # actions and the databases that their models name, or else the first one
    stores = mine.filter("type = 'database'").select(REPO, c("node_id").alias("dst"), F.lower("label").alias("low"), F.regexp_replace(F.lower("label"), r"^db:\s*", "").alias("name"), F.concat_ws("|", "path", F.lpad(c("place").cast("string"), 9, "0")).alias("dst_order"))
    asked = mine.filter("type = 'action'").select(REPO, "models").distinct().select(REPO, "models", F.posexplode("models").alias("at", "model"))
    names = asked.select(REPO, "model").distinct()
    met = union([x.select(REPO, "model", "dst") for x in (contains_join(stores.select(REPO, "dst", "low"), "low", names, "model"), contains_join(names.withColumn("whole", c("model")), "whole", stores.select(REPO, "dst", "name"), "name"))]).distinct()
    # what a list of models leads to is found once for all actions that have it
    found = keep_first(asked.join(met, [REPO, "model"]).select(REPO, "models", "dst", "at", "model"), [REPO, "models", "dst"], ["at"])
    found = written(found.join(stores.select(REPO, "dst", "dst_order"), [REPO, "dst"]))
    add(each("action").join(found.select(REPO, "models").distinct(), [REPO, "models"], "left_anti"), 10, c("node_id"), c("first_database"), "query")
    stored = each("database").filter("trigger IS NOT NULL")
    saver = F.when(c("trigger") == "update profile", c("first_UPDATE")).otherwise(c("first_CREATE"))
    add(stored, 11, F.coalesce(saver, c("first_action")), c("node_id"), c("edge"))
    chain("middleware", 12, "chain")
    add(each("middleware"), 13, c("node_id"), c("first_action"), "guard")
    add(marks, 14, c("first_auth"), c("first_middleware"), "protected by")
    add(each("external_service"), 15, F.coalesce("first_action", "first_walk"), c("node_id"), F.when(c("first_action").isNotNull(), "call external").otherwise("integrate"))
    add(each("service"), 16, c("first_action"), c("node_id"), "enqueue", 0)
    add(each("service"), 16, c("node_id"), F.when(c("bus"), F.lit(SERVICE_BUS)).otherwise(c("first_database")), F.when(c("bus"), "publish").otherwise("process"), 1)
    add(marks.filter("bus"), 17, F.lit(SERVICE_BUS), c("first_database"), "process")
    add(each("error_handler"), 18, c("first_action"), c("node_id"), "catch error", 0)
    add(each("error_handler"), 18, c("node_id"), c("first_database"), "log", 1)
    chain("cache", 19, "chain")
    add(marks, 20, c("first_action"), c("first_cache"), "check cache", 0)
    add(marks, 20, c("first_cache"), c("first_database"), "cache miss", 1)
    chain("database", 21, "relate")
    here = _last(entered, "last_walk", "last_action", "last_database")
    inputs = each("validation").join(own.select(REPO, "path"), [REPO, "path"], "left_anti").filter("first_walk IS NOT NULL")
    add(inputs, 22, c("first_walk"), c("node_id"), "submit", 0)
    add(inputs, 22, c("node_id"), F.coalesce(c("first_action"), c("first_logout"), here), "valid", 1)
    add(inputs, 22, c("node_id"), c("first_error_handler"), "invalid → error", 2)
    add(marks, 23, F.when(c("first_logout").isNotNull(), here), c("first_logout"), "session end")
    add(marks, 24, F.coalesce(c("first_logout"), here), F.lit(LOOP), "complete")
    add(marks, 25, F.lit(LOOP), F.lit(LANDING), "restart")
    every = union(parts).filter("src IS NOT NULL AND dst IS NOT NULL")
    once = keep_first(every, [REPO, "src", "dst", "kind"], ["stage", "path", "place", "sub"])
    return once, mine.filter("type = 'action'").select(REPO, "models", "node_id", "crud", "path", "place"), found


def uses(joined: DataFrame) -> DataFrame:
    """The edges of actions that have met their databases."""
    c = F.col
    return joined.select(REPO, c("node_id").alias("src"), "dst", F.concat("crud", F.lit(" → "), "model").alias("kind"), F.lit(100).alias("stage"), "path", "place", c("dst_order").alias("sub"))


def _dealt(actions: DataFrame, found: DataFrame) -> DataFrame:
    """The join by list of models. Its rows are far more than those that meet, so the actions of a list are dealt over many tasks."""
    tasks = int(actions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [REPO, "models", "piece"]
    some = actions.withColumn("piece", F.pmod(F.xxhash64("node_id"), F.lit(PIECES)).cast("int")).repartition(tasks, *by)
    return some.join(found.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))).repartition(tasks, *by).hint("shuffle_hash"), by)


def in_tree(kind: Column) -> Column:
    """Whether an edge belongs to the tree and does not only converge."""
    return ~kind.isin(CONVERGING) & ~kind.rlike(CONVERGING_CRUD)


def with_bridges(nodes: DataFrame, edges: DataFrame, actions: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with bridges, and edges (repo_id, src, dst, kind): the first tree edge from each section to another one goes over a bridge.

    Of the databases that an action uses only the first of each section can be
    the one, so that all of them need not be met to find it.
    """
    by_type = F.coalesce(*[F.when(F.col("type") == k, s) for k, s in TYPE_SECTIONS.items()], F.lit("misc"))
    home = F.when(F.col("type").isin("start", "end", "logout"), by_type).otherwise(F.coalesce("section", by_type))
    column = F.when(F.col("node_id") == LANDING, 1).otherwise(F.coalesce(*[F.when(F.col("type") == k, x) for k, (x, _) in TYPES.items()]))
    placed = nodes.withColumns({"col": column, "home": home})
    side = lambda end: placed.select(REPO, F.col("node_id").alias(end), F.col("home").alias(f"{end}_home"), F.col("type").alias(f"{end}_type"), F.col("col").alias(f"{end}_col"))
    homes = found.join(placed.select(REPO, F.col("node_id").alias("dst"), "home"), [REPO, "dst"])
    nearest = keep_first(homes, [REPO, "models", "home"], ["dst_order", "dst"]).drop("home")
    crossing = edges.unionByName(uses(actions.join(nearest, [REPO, "models"])))
    crossing = crossing.filter(in_tree(F.col("kind")) & (F.col("src") != F.col("dst"))).join(side("src"), [REPO, "src"]).join(side("dst"), [REPO, "dst"])
    crossing = crossing.filter("src_home <> dst_home AND src_home <> 'entry' AND dst_home <> 'entry' AND src_type NOT IN ('start', 'end') AND dst_type NOT IN ('start', 'end')")
    first = written(keep_first(crossing, [REPO, "src_home", "dst_home"], ["stage", "path", "place", "sub", "src", "dst", "kind"]))
    label = F.concat(*[F.coalesce(*[F.when(F.col(end) == k, v) for k, v in SECTION_LABELS.items()]) if end else F.lit(" → ") for end in ("src_home", "", "dst_home")])
    bridge = F.concat_ws(":", F.lit("bridge"), "src_home", "dst_home")
    # bridges come in the order of the edges that they take
    place = F.concat_ws("|", F.lpad(F.col("stage").cast("string"), 3, "0"), "path", F.lpad(F.col("place").cast("string"), 9, "0"), "sub")
    made = first.select(
        REPO, bridge.alias("node_id"), F.lit("bridge").alias("type"), label.alias("label"), place.alias("path"), F.lit(None).cast("string").alias("section"),
        F.lit(BRIDGES).alias("phase"), F.lit(0).alias("place"), *_nulls(), (F.least("src_col", "dst_col") + 1).alias("col"), F.lit(None).cast("string").alias("home"),
    )
    plain = edges.unionByName(uses(_dealt(actions, found))).select(REPO, "src", "dst", "kind").join(first.select(REPO, "src", "dst", "kind"), [REPO, "src", "dst", "kind"], "left_anti")
    over = [first.select(REPO, "src", bridge.alias("dst"), F.lit("next section").alias("kind")), first.select(REPO, bridge.alias("src"), "dst", F.lit("next section").alias("kind"))]
    return placed.unionByName(made), union([plain, *over])


def tree_ends(edges: DataFrame, actions: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo_id, node_id) of the nodes that tree edges lead to, and of those they come from; a bridge keeps both ends of its edge."""
    tree = edges.filter(in_tree(F.col("kind")))
    using = actions.filter(in_tree(F.concat("crud", F.lit(" → "))))
    used = found.join(using.select(REPO, "models").distinct(), [REPO, "models"], "left_semi").select(REPO, F.col("dst").alias("node_id"))
    using = using.join(found.select(REPO, "models").distinct(), [REPO, "models"], "left_semi").select(REPO, "node_id")
    return tree.select(REPO, F.col("dst").alias("node_id")).unionByName(used).distinct(), tree.select(REPO, F.col("src").alias("node_id")).unionByName(using).distinct()


def attached(nodes: DataFrame, edges: DataFrame, into: DataFrame, out: DataFrame) -> DataFrame:
    """`edges` and those that give every node but start a way in and every node but end a way out of the tree.

    A node without a way in is led to from the first node of the nearest column
    before its own, one without a way out leads to the first node of the nearest
    column behind it. All nodes are judged by `tree_ends`; edges are given once.
    """
    order = F.struct("phase", "path", "place", "node_id")
    columns = nodes.filter("type <> 'bridge'").groupBy(REPO, "col").agg(F.min(order).getField("node_id").alias("head"), F.max(F.col("type") == "end").alias("is_end"))
    heads = columns.groupBy(REPO).agg(F.sort_array(F.collect_list(F.struct("col", "head", "is_end"))).alias("heads"))  # nine columns at most
    open_ = nodes.filter("type <> 'bridge'").select(REPO, "node_id", "type", "col").join(heads, REPO)
    before = F.element_at(F.filter("heads", lambda h: h["col"] < F.col("col")), -1)["head"]
    behind = F.get(F.filter("heads", lambda h: (h["col"] > F.col("col")) & ~h["is_end"]), F.lit(0))["head"]
    no_in = open_.filter("type <> 'start'").join(into, [REPO, "node_id"], "left_anti")
    no_out = open_.filter("type <> 'end'").join(out, [REPO, "node_id"], "left_anti")
    flow = F.lit("flow").alias("kind")
    # only these may be there already
    same = F.col("kind") == "flow"
    led = [no_in.select(REPO, F.coalesce(before, F.lit(START)).alias("src"), F.col("node_id").alias("dst"), flow), no_out.select(REPO, F.col("node_id").alias("src"), F.coalesce(behind, F.lit(LOOP)).alias("dst"), flow)]
    return edges.filter(~same).unionByName(union([edges.filter(same), *led]).distinct())


def journey_graph(files: DataFrame, repos: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (repo_id, node_id, type, label, shape, col, row, path) and edges (repo_id, src, dst, kind) of each repository's journey.

    See `journey_nodes`, `woven`, `with_bridges` and `attached` for the steps. A
    file that repeats counts once; a null text is empty. col is the lane of a
    type, row the number within it.
    """
    nodes = written(journey_nodes(files, repos))
    edges, actions, found = woven(nodes)
    edges = written(edges)
    placed, bridged = with_bridges(nodes, edges, actions, found)
    placed = written(placed)
    joined = attached(placed, bridged, *tree_ends(edges, actions, found))
    shape = F.coalesce(*[F.when(F.col("type") == k, s) for k, (_, s) in TYPES.items()])
    rows = ranked(placed, [REPO, "col"], ["phase", "path", "place", "node_id"], "row")
    path = F.when(F.col("phase") == FILES, F.col("path"))
    shown = rows.select(REPO, "node_id", "type", "label", shape.alias("shape"), "col", (F.col("row") - 1).alias("row"), path.alias("path"))
    return shown, joined
