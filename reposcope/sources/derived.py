"""Source files, graphs, snapshots and schemas derived from the driver's tables.

Each table is one SQL text that Spark and DuckDB both run, so that a query and
the SQL that states its result read the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from reposcope.sources.tables import forget, written


def template(text: str) -> str:
    """SQL for a text with {columns} in it."""
    parts = []
    for piece in re.split(r"(\{\w+\}|\n)", text):
        if piece == "\n":
            parts.append("chr(10)")
        elif re.fullmatch(r"\{\w+\}", piece):
            parts.append(piece[1:-1])
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)


PAGE = """import Link from "next/link";
import { useForm } from "./form{m}";
import Card from "@/components/Card{m}";
const schema = z.object({ email: z.string() });
export default function Page() {
  if (!user) { return null; }
  fetch("/api/{t}", { method: "POST", body: data });
  fetch('/api/items{m}');
  return <Link href="/{t}/list">go</Link>;
}
"""
FORM = """import axios from "axios";
import * as yup from 'yup';
const schema = yup.object({ name: yup.string() });
export const useForm = async () => {
  axios.post("/api/{t}", data);
  for (const x of rows) { if (x && x.id || y) { router.push("/{t}"); } }
  const v = a ?? b;
  return ok ? 1 : 0;
};
"""
ROUTE = """import { supabase } from "@/lib/util{m}";
export async function GET(request) {
  const rows = await supabase.from("{t}").select();
  return rows;
}
export async function POST(request) {
  await supabase.from("{t}").insert(request);
  await supabase.from("audit_log").insert(request);
  stripe.charges.create({ amount: 1 });
}
"""
HANDLER = """const prisma = require("../../lib/util{m}");
export default async function handler(req, res) {
  if (req.method === "GET") { res.json(await prisma.{t}.findMany()); }
  else if (req.method === "POST") { await prisma.{t}.create({ data: req.body }); }
  try { await prisma.user.count(); } catch (e) { throw new Error("no"); }
}
"""
CARD = """import Base from "./Card{k}";
import { fmt } from "../lib/util{m}";
import "./styles.css";
// if (x) a comment, "not && counted"
export function Card{n}({ item }) {
  return item ? <Route path="/{t}/:id" element={fmt(item)} /> : null;
}
export { fmt as format, Base };
"""
PACKAGE = """{"name": "app{n}", "dependencies": {"react": "18", "lib{m}": "1"}, "devDependencies": {"vitest": "1"}}"""
DDL = """CREATE TABLE {t} (
  id SERIAL PRIMARY KEY,
  name VARCHAR(40) NOT NULL UNIQUE,
  total NUMERIC(10, 2) DEFAULT 0,
  owner_id INTEGER REFERENCES users(id)
);
ALTER TABLE {t} ADD COLUMN note TEXT;
"""
UTIL = """import { helper } from "./util{k}";
export const url = process.env.API_URL || "x";
export const key = process.env.KEY_{m};
export const mode = import.meta.env.MODE{m} ?? "dev";
app.get("/health/{t}", (req, res) => res.send("ok"));
app.post('/items/:id', save);
while (true) { switch (x) { case 1: break; } }
"""

SCREEN = """import Nav from "./nav{m}";
export default function Screen{n}() {
  if (!session) { redirect("/{t}/login"); }
  const form = z.object({ name: z.string() });
  return <div>
    <Link href="/{t}/s{k}?tab=1">next</Link>
    <a href='/{t}/s{m}'>home</a> <a href="/users/9{m}/w{n}">one</a>
    <button onClick={() => router.push("/{t}/s{m}")}>go</button>
    <button onClick={() => open()}>open</button>
  </div>;
}
"""
WIZARD = """import { Order } from "../models/{t}-model";
import { list } from "../services/order_{m}.service";
import type { Row } from "@/lib/rows{m}";
export function Wizard() {
  navigate("/{t}/s{n}/"); navigate({ to: "/{t}/s{k}" });
  if (pathname === "/{t}/s{m}x") { history.push('/users/s{m}'); }
  const ok = Joi.object({}); yup.string();
  return <form encType="multipart/form-data" onSubmit={async () => {
    await fetch("/api/{t}/{n}"); prisma.{t}.create({});
  }}><input type="file" /></form>;
}
"""
WORKER = """import { queue } from "bullmq";
import os from "os";
import "../db/schema{m}.sql";
queue.add("mail", {}); client.find({}); User.save();
const a = supabase.from("user_{t}").select();
if (errors) { throw errors; }
schema.safeParse(x).validate();
"""
VERCEL = """{"functions": {"api/{t}.ts": {"memory": 512}}, "storage": "blob{m}"}"""
TERRAFORM = """resource "aws_s3_bucket" "assets{m}" {
  bucket = "assets-{t}"
}
resource "aws_lambda_function" "job{n}" {}
resource "aws_cloudfront_distribution" "cdn{m}" {}
"""
SCREENS = f"""
SELECT 'r' || CAST(p_partkey % 20 AS STRING) AS repo_id,
  CASE kind WHEN 0 THEN 'app/' || t || '/s' || n || '/page.tsx' WHEN 1 THEN 'app/(flow)/' || t || '/[id]/w' || n || '/page.tsx' WHEN 2 THEN 'pages/' || t || '/s' || n || '.tsx'
    WHEN 3 THEN 'src/handlers/' || t || '_handler' || n || '.ts' WHEN 4 THEN 'app' || m || '/vercel.json' ELSE 'infra/' || t || n || '.tf' END AS path,
  CASE kind WHEN 0 THEN {template(SCREEN)} WHEN 1 THEN {template(WIZARD)} WHEN 2 THEN {template(SCREEN)} WHEN 3 THEN {template(WORKER)} WHEN 4 THEN {template(VERCEL)} ELSE {template(TERRAFORM)} END AS source
FROM (
  SELECT p_partkey, CAST(floor(p_partkey / 20) AS BIGINT) % 6 AS kind, CAST(CAST(floor(p_partkey / 120) AS BIGINT) AS STRING) AS n,
    CAST(CAST(floor(p_partkey / 120) AS BIGINT) % 5 AS STRING) AS m, CAST(CAST(floor(p_partkey / 120) AS BIGINT) + 1 AS STRING) AS k,
    CASE p_partkey % 3 WHEN 0 THEN 'users' WHEN 1 THEN 'posts' ELSE 'orders' END AS t
  FROM part
) AS p
"""

PYTHON = """import os
from app.{t} import Base
class Service{n}(Base, Mixin{m}):
    def load(self, key):
        return self.clean(key)
    @cached
    async def clean(self, key):
        return helper(key) + print(key)
def helper(x):
    # def hidden(y):
    return Service{n}(x)
"""
PHP = """<?php
use Order{m};
Route::get('/{t}/{n}', [Ctrl{n}::class, 'index']);
class Ctrl{n} extends Controller {
    public function index($id) {
        $this->show($id);
        self::find($id); Other::find($id);
    }
    public static function find($id) { return $id; }
    private function show($id) {
        return Ctrl{n}::find($id);
    }
}
"""
JAVA = """import java.util.List;
@RestController
public class Api{n} extends Base{m}<Order> implements Closeable {
    @GetMapping("/{t}/{n}")
    public List<Order> list(String q) {
        if (q == null) { return find(q); }
    }
    @PostMapping
    private Order save(Order o) throws IOException {
    }
}
"""
GO = """package main
import "fmt"
type Store{n} struct {
}
func (s *Store{n}) Get(id string) string {
	return s.find(id)
}
func main() {
}
"""
CLANG = """#include <stdio.h>
struct node{m} {
  int id;
};
static int count_{t}(struct node *n) {
  while (n) { n = next(n); }
}
"""
CPP = """#include "base{m}.h"
class Shape{n} : public Base{m}, private Util {
  void draw(int x) override {
  }
};
"""
CSHARP = """using System.Linq;
public class Items{n} : ControllerBase, IItems {
    [HttpGet("{t}/{n}")]
    public async Task<Item> Get(int id) {
    }
    [HttpDelete]
    public void Drop(int id) {
    }
}
"""
CODE = f"""
SELECT 'r' || CAST(p_partkey % 20 AS STRING) AS repo_id, 'src/' || t || '/file' || n || CASE kind WHEN 0 THEN '.py' WHEN 1 THEN '.php' WHEN 2 THEN '.java' WHEN 3 THEN '.go' WHEN 4 THEN '.c' WHEN 5 THEN '.cpp' ELSE '.cs' END AS path,
  CASE kind WHEN 0 THEN {template(PYTHON)} WHEN 1 THEN {template(PHP)} WHEN 2 THEN {template(JAVA)} WHEN 3 THEN {template(GO)} WHEN 4 THEN {template(CLANG)} WHEN 5 THEN {template(CPP)} ELSE {template(CSHARP)} END AS source
FROM (
  SELECT p_partkey, CAST(floor(p_partkey / 20) AS BIGINT) % 7 AS kind, CAST(CAST(floor(p_partkey / 140) AS BIGINT) AS STRING) AS n, CAST(CAST(floor(p_partkey / 140) AS BIGINT) % 4 AS STRING) AS m,
    CASE p_partkey % 3 WHEN 0 THEN 'users' WHEN 1 THEN 'posts' ELSE 'orders' END AS t
  FROM part
) AS p
"""

MODULES = f"""
SELECT 'r' || CAST(p_partkey % 20 AS STRING) AS repo_id,
  CASE kind WHEN 0 THEN 'app/(main)/' || t || '/n' || n || '/page.tsx' WHEN 1 THEN 'app/' || t || '/[id]/form' || m || '.tsx'
    WHEN 2 THEN 'app/api/' || t || '/v' || n || '/route.ts' WHEN 3 THEN 'pages/api/' || t || '/' || n || '.ts'
    WHEN 4 THEN 'src/components/Card' || n || '.tsx' WHEN 5 THEN 'packages/app' || n || '/package.json'
    WHEN 6 THEN 'db/schema' || n || '.sql' ELSE 'src/lib/util' || n || '.ts' END AS path,
  CASE kind WHEN 0 THEN {template(PAGE)} WHEN 1 THEN {template(FORM)} WHEN 2 THEN {template(ROUTE)} WHEN 3 THEN {template(HANDLER)}
    WHEN 4 THEN {template(CARD)} WHEN 5 THEN {template(PACKAGE)} WHEN 6 THEN {template(DDL)} ELSE {template(UTIL)} END AS source
FROM (
  SELECT p_partkey, CAST(floor(p_partkey / 20) AS BIGINT) % 8 AS kind, CAST(CAST(floor(p_partkey / 160) AS BIGINT) AS STRING) AS n,
    CAST(CAST(floor(p_partkey / 160) AS BIGINT) % 7 AS STRING) AS m, CAST(CAST(floor(p_partkey / 160) AS BIGINT) + 1 AS STRING) AS k,
    CASE p_partkey % 5 WHEN 0 THEN 'users' WHEN 1 THEN 'posts' WHEN 2 THEN 'user_profiles' WHEN 3 THEN 'orders' ELSE 'categories' END AS t
  FROM part
) AS p
"""

POSTGRES = """-- table of {t}; CREATE TABLE hidden (x INT);
CREATE TABLE {t}_{n} (
  id SERIAL PRIMARY KEY,
  key TEXT DEFAULT ')',
  index_no INTEGER NOT NULL,
  note TEXT DEFAULT '--x, (',
  owner_id INTEGER UNIQUE REFERENCES users(id)
);
"""
MYSQL = """CREATE TABLE `{t}_{n}` (
  `id` INT AUTO_INCREMENT PRIMARY KEY,
  `email` VARCHAR(255) NOT NULL, # a comment, with (
  `parent` BIGINT,
  `price` DECIMAL(10, 2),
  UNIQUE KEY `u{m}` (`email`),
  CONSTRAINT `fk{m}` FOREIGN KEY (`parent`) REFERENCES `users{m}` (`no`)
) ENGINE=InnoDB;
"""
SQLITE = """CREATE TABLE {t}_{n} (
  id INTEGER PRIMARY KEY AUTOINCREMENT,
  kind TEXT UNIQUE,
  user_id INTEGER
);
ALTER TABLE {t}_{n} ADD CONSTRAINT fk{m} FOREIGN KEY (user_id) REFERENCES people{m}(id);
"""
DDL_FILES = f"""
SELECT 'r' || CAST(p_partkey % 20 AS STRING) AS repo_id, 'db/' || t || n || '.sql' AS path,
  CASE kind WHEN 0 THEN {template(POSTGRES)} WHEN 1 THEN {template(MYSQL)} ELSE {template(SQLITE)} END AS source
FROM (
  SELECT p_partkey, CAST(floor(p_partkey / 20) AS BIGINT) % 3 AS kind, CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING) AS n, CAST(p_partkey % 7 AS STRING) AS m,
    CASE p_partkey % 4 WHEN 0 THEN 'users' WHEN 1 THEN 'posts' WHEN 2 THEN 'orders' ELSE 'tags' END AS t
  FROM part
) AS p
"""

WALK_PAGE = """import A from "./a";
import S from "@/shared/s{m}";
export default function Page() { return <A/>; }
{l}
"""
WALK_CHILD = """import S from "@/shared/s{h}";
import B from "./b";
const ok = z.object({ name: z.string() });
<button onClick={() => router.push("/p{m}")}>go</button>
"""
WALK_LEAF = """import A from "./a";
{l}
const other = "/p{m}";
"""
WALK_SHARED = """{i}
export const f = () => { if (!user) { return null; } };
<form onSubmit={() => fetch("/api/p{m}")}></form>
"""
# every third page and every second leaf has a link; a shared file imports the next one unless its number leaves 2 by 3
WALKS = f"""
SELECT repo_id, CASE kind WHEN 0 THEN 'app/p' || n || '/page.tsx' WHEN 1 THEN 'app/p' || n || '/a.tsx' WHEN 2 THEN 'app/p' || n || '/b.tsx' ELSE 'src/shared/s' || n || '.tsx' END AS path,
  CASE kind WHEN 0 THEN {template(WALK_PAGE)} WHEN 1 THEN {template(WALK_CHILD)} WHEN 2 THEN {template(WALK_LEAF)} ELSE {template(WALK_SHARED)} END AS source
FROM (
  SELECT repo_id, kind, CAST(num AS STRING) AS n, CAST(num % 7 AS STRING) AS m, CAST(num % 5 AS STRING) AS h,
    CASE WHEN kind = 0 AND num % 3 = 0 OR kind = 2 AND num % 2 = 1 THEN '<Link href="/p' || CAST(num + 1 AS STRING) || '?x=1">next</Link>' ELSE '' END AS l,
    CASE WHEN num % 3 <> 2 THEN 'import N from "./s' || CAST(num + 1 AS STRING) || '";' ELSE '' END AS i
  FROM (SELECT 'r' || CAST(p_partkey % 20 AS STRING) AS repo_id, CAST(floor(p_partkey / 20) AS BIGINT) % 4 AS kind, CAST(floor(p_partkey / 80) AS BIGINT) AS num FROM part) AS p
) AS q
"""

_LINKS = """
SELECT DISTINCT 'r' || CAST(o_custkey % 10 AS STRING) AS repo_id, o_orderkey AS o, l_partkey AS p, l_suppkey AS s
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

NODES = f"""
SELECT 'r' || CAST(c_custkey % 10 AS STRING) AS repo_id, 'c' || CAST(c_custkey AS STRING) AS node_id, 'view' AS type, '/' || lower(c_mktsegment) || '/' || CAST(c_custkey AS STRING) AS label,
  'pill' AS shape, c_acctbal AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM customer
UNION ALL SELECT 'r' || CAST(o_custkey % 10 AS STRING), 'o' || CAST(o_orderkey AS STRING), 'controller', '/api/' || o_orderpriority || '/' || CAST(o_orderkey AS STRING),
  'rectangle', o_totalprice, CAST(o_orderkey % 89 AS DOUBLE) FROM orders
UNION ALL SELECT DISTINCT repo_id, 'p' || CAST(p AS STRING), 'database', 'table_' || CAST(p AS STRING), 'cylinder', CAST(p AS DOUBLE), 1.0 FROM ({_LINKS}) AS l1
UNION ALL SELECT DISTINCT repo_id, 's' || CAST(s AS STRING), 'validation', 'validate_' || CAST(s AS STRING), 'diamond', CAST(s AS DOUBLE), 2.0 FROM ({_LINKS}) AS l2
"""

EDGES = f"""
SELECT 'r' || CAST(o_custkey % 10 AS STRING) AS repo_id, 'c' || CAST(o_custkey AS STRING) AS src, 'o' || CAST(o_orderkey AS STRING) AS dst, 'call' AS kind FROM orders
UNION ALL SELECT DISTINCT repo_id, 'o' || CAST(o AS STRING), 'p' || CAST(p AS STRING), 'query' FROM ({_LINKS}) AS l1
UNION ALL SELECT DISTINCT repo_id, 's' || CAST(s AS STRING), 's' || CAST((s * 7 + 3) % 100 AS STRING), 'reference' FROM ({_LINKS}) AS l2
UNION ALL SELECT DISTINCT repo_id, 's' || CAST(s AS STRING), 'p' || CAST(p AS STRING), 'query' FROM ({_LINKS}) AS l3 WHERE s % 5 = 3 AND p % 20 = 0
UNION ALL SELECT 'r' || CAST(c_custkey % 10 AS STRING), 'c' || CAST(c_custkey AS STRING), 's' || CAST(c_custkey % 100 AS STRING), 'validate' FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT DISTINCT 'r' || CAST(o_custkey % 10 AS STRING), 'c' || CAST(o_custkey AS STRING), 'p' || CAST(l_partkey AS STRING), 'query'
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 49
"""

BASE = "SELECT 'r' || CAST(o_custkey % 10 AS STRING) AS repo_id, o_orderkey AS id, o_orderpriority AS label, o_orderstatus AS shape FROM orders WHERE o_orderkey % 7 <> 0"
HEAD = """SELECT 'r' || CAST(o_custkey % 10 AS STRING) AS repo_id, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority || '*' ELSE o_orderpriority END AS label,
  CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS shape FROM orders WHERE o_orderkey % 11 <> 0"""

SECTIONS = """SELECT 'r' || CAST(r AS STRING) AS repo_id, 'sec' || CAST(n_nationkey AS STRING) AS section_id, n_name AS label,
  n_nationkey * 20000.0 AS x, n_regionkey * 10.0 AS y, 30000.0 AS w, 45.0 AS h
FROM nation CROSS JOIN (SELECT DISTINCT o_custkey % 10 AS r FROM orders) AS repos"""

CHANGES = """SELECT event_id, ts, 'r' || CAST(user_id % 10 AS STRING) AS repo_id, 'n' || CAST(user_id AS STRING) AS node_id, 'src/mod' || CAST(user_id % 40 AS STRING) || '/file' || CAST(user_id AS STRING) || '.ts' AS path,
  CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change, value
FROM events"""

#: Derived table: its SQL and the driver's tables that it reads.
TABLES = {
    "modules": (MODULES, ["part"]),
    "screens": (SCREENS, ["part"]),
    "code": (CODE, ["part"]),
    "sources": (f"{MODULES} UNION ALL {SCREENS}", ["part"]),
    "ddl_files": (DDL_FILES, ["part"]),
    "walks": (WALKS, ["part"]),
    "nodes": (NODES, ["customer", "orders", "lineitem"]),
    "edges": (EDGES, ["customer", "orders", "lineitem"]),
    "base": (BASE, ["orders"]),
    "head": (HEAD, ["orders"]),
    "sections": (SECTIONS, ["nation", "orders"]),
    "changes": (CHANGES, ["events"]),
}


#: Rows of `part` from which a task makes source texts.
PIECE = 10_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. Texts of half a kilobyte are made from eight bytes of `part`, whose splits by size are too few for them."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name != "part":
        return table
    keys = table.select("p_partkey")
    pieces = -(-keys.count() // PIECE)
    return keys.repartition(pieces, "p_partkey") if pieces > 1 else keys


def _over(spark: SparkSession, sf_dir: str, text: str, reads: list[str], **made: DataFrame) -> DataFrame:
    """The rows of an SQL text over Parquet tables in `sf_dir` and tables that are in braces already."""
    for t in reads:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    names = [*reads, *made]
    # every other brace belongs to a source text
    text = re.sub(r"\{(?!(?:" + "|".join(names) + r")\})", "{{", text)
    text = re.sub(r"(?<!" + ")(?<!".join(r"\{" + t for t in names) + r")\}", "}}", text)
    return spark.sql(text, **{t: _read(spark, sf_dir, t) for t in reads}, **made)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the Parquet tables in `sf_dir`."""
    text, reads = TABLES[name]
    return _over(spark, sf_dir, text, reads)


#: Order lines with their orders, k the number of the repository; `first` marks one row for each repository, order and part.
#: The join deals rows by their order, so that the rows of an order's parts need no second exchange.
_JOINED = """SELECT o_custkey AS c, o_custkey % 10 AS k, o_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_quantity > 49 AS many,
  row_number() OVER (PARTITION BY o_custkey % 10, o_orderkey, l_partkey ORDER BY l_suppkey) = 1 AS first
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
#: Parts of NODES and EDGES that read order lines, and the same rows from `joined` and `suppliers`: numbers are made distinct, and names made of them.
_FROM_JOINED = {
    f"SELECT DISTINCT repo_id, 'p' || CAST(p AS STRING), 'database', 'table_' || CAST(p AS STRING), 'cylinder', CAST(p AS DOUBLE), 1.0 FROM ({_LINKS}) AS l1":
        "SELECT 'r' || CAST(k AS STRING), 'p' || CAST(p AS STRING), 'database', 'table_' || CAST(p AS STRING), 'cylinder', CAST(p AS DOUBLE), 1.0 FROM (SELECT DISTINCT k, p FROM {joined}) AS l1",
    f"SELECT DISTINCT repo_id, 's' || CAST(s AS STRING), 'validation', 'validate_' || CAST(s AS STRING), 'diamond', CAST(s AS DOUBLE), 2.0 FROM ({_LINKS}) AS l2":
        "SELECT 'r' || CAST(k AS STRING), 's' || CAST(s AS STRING), 'validation', 'validate_' || CAST(s AS STRING), 'diamond', CAST(s AS DOUBLE), 2.0 FROM {suppliers} AS l2",
    f"SELECT DISTINCT repo_id, 'o' || CAST(o AS STRING), 'p' || CAST(p AS STRING), 'query' FROM ({_LINKS}) AS l1":
        "SELECT 'r' || CAST(k AS STRING), 'o' || CAST(o AS STRING), 'p' || CAST(p AS STRING), 'query' FROM {joined} AS l1 WHERE first",
    f"SELECT DISTINCT repo_id, 's' || CAST(s AS STRING), 's' || CAST((s * 7 + 3) % 100 AS STRING), 'reference' FROM ({_LINKS}) AS l2":
        "SELECT 'r' || CAST(k AS STRING), 's' || CAST(s AS STRING), 's' || CAST((s * 7 + 3) % 100 AS STRING), 'reference' FROM {suppliers} AS l2",
    f"SELECT DISTINCT repo_id, 's' || CAST(s AS STRING), 'p' || CAST(p AS STRING), 'query' FROM ({_LINKS}) AS l3 WHERE s % 5 = 3 AND p % 20 = 0":
        "SELECT 'r' || CAST(k AS STRING), 's' || CAST(s AS STRING), 'p' || CAST(p AS STRING), 'query' FROM (SELECT DISTINCT k, s, p FROM {joined} WHERE s % 5 = 3 AND p % 20 = 0) AS l3",
    "SELECT DISTINCT 'r' || CAST(o_custkey % 10 AS STRING), 'c' || CAST(o_custkey AS STRING), 'p' || CAST(l_partkey AS STRING), 'query'\n  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 49":
        "SELECT 'r' || CAST(c % 10 AS STRING), 'c' || CAST(c AS STRING), 'p' || CAST(p AS STRING), 'query' FROM (SELECT DISTINCT c, p FROM {joined} WHERE many) AS l4",
}


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The derived nodes and edges as written tables, for jobs that read them several times.

    The join of order lines, which six of their parts begin with, is made once.
    """
    joined = written(_over(spark, sf_dir, _JOINED, ["orders", "lineitem"]))
    suppliers = written(joined.select("k", "s").distinct())

    def made(name: str) -> DataFrame:
        text = TABLES[name][0]
        for part, same in _FROM_JOINED.items():
            text = text.replace(part, same)
        return written(_over(spark, sf_dir, text, [t for t in TABLES[name][1] if t != "lineitem"], joined=joined, suppliers=suppliers))

    nodes, edges = made("nodes"), made("edges")
    forget(joined)
    forget(suppliers)
    return nodes, edges


def stated(sql: str) -> str:
    """`sql` with the derived tables that it names in front, as DuckDB runs it."""
    used = [n for n in TABLES if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({TABLES[n][0]})" for n in used)
    if not used:
        return sql
    body = re.sub(r"^\s*WITH RECURSIVE\s", "", sql) if re.match(r"\s*WITH RECURSIVE", sql) else re.sub(r"^\s*WITH\s", "", sql)
    start = "WITH RECURSIVE" if re.match(r"\s*WITH RECURSIVE", sql) else "WITH"
    joined = ", " if re.match(r"\s*WITH\b", sql) else " "
    return f"{start} {ctes}{joined}{body}"
