"""Schema catalogs from SQL DDL: columns with keys, references and types."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Raw types by universal type, and native types by dialect and universal type.
UNIVERSAL = {
    "INTEGER": ["SERIAL", "BIGSERIAL", "SMALLSERIAL", "INT", "INTEGER", "SMALLINT", "BIGINT", "TINYINT", "MEDIUMINT"],
    "TEXT": ["VARCHAR", "CHAR", "CHARACTER", "TEXT", "CLOB", "LONGTEXT", "MEDIUMTEXT", "TINYTEXT", "NCHAR", "NVARCHAR"],
    "NUMERIC": ["FLOAT", "DOUBLE", "DOUBLE PRECISION", "DECIMAL", "NUMERIC", "DEC"],
    "REAL": ["REAL"],
    "BLOB": ["BLOB", "BINARY", "VARBINARY", "LONGBLOB", "MEDIUMBLOB", "TINYBLOB", "BYTEA"],
    "BOOLEAN": ["BOOLEAN", "BOOL"],
    "TIMESTAMP": ["TIMESTAMP", "DATETIME", "DATE", "TIME", "TIMESTAMPTZ"],
    "JSON": ["JSON", "JSONB"],
    "UUID": ["UUID"],
}
NATIVE = {
    "postgresql": {"INTEGER": "INTEGER", "TEXT": "TEXT", "REAL": "REAL", "NUMERIC": "NUMERIC(10,2)", "BLOB": "BYTEA", "BOOLEAN": "BOOLEAN", "TIMESTAMP": "TIMESTAMPTZ", "JSON": "JSONB", "UUID": "UUID"},
    "mysql": {"INTEGER": "INT", "TEXT": "TEXT", "REAL": "DOUBLE", "NUMERIC": "DECIMAL(10,2)", "BLOB": "LONGBLOB", "BOOLEAN": "TINYINT(1)", "TIMESTAMP": "DATETIME", "JSON": "JSON", "UUID": "CHAR(36)"},
    "sqlite": {"INTEGER": "INTEGER", "BOOLEAN": "INTEGER", "TEXT": "TEXT", "JSON": "TEXT", "UUID": "TEXT", "TIMESTAMP": "TEXT", "REAL": "REAL", "NUMERIC": "REAL", "BLOB": "BLOB"},
}
_TABLES = "table_no int, table_name string, engine string, clauses array<struct<clause: string, flat: string>>"
# one alternative a token: comments, literals, quoted names, words and numbers, signs
_TOKEN = re.compile(r"(--[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z))|('(?:[^']|'')*(?:'|\Z))|(\"(?:[^\"]|\"\")*\"|`[^`]*`|\[\w[^\]]*\])|(\w+)|\S", re.DOTALL)
_CREATE = re.compile(r'CREATE (?:GLOBAL |LOCAL )?(?:TEMP |TEMPORARY |UNLOGGED )?TABLE (?:IF NOT EXISTS )?(?:(?:"[^"]*"|\w+) \. )*("[^"]*"|\w+)', re.IGNORECASE)
_ALTER = re.compile(r'ALTER TABLE (?:ONLY )?(?:(?:"[^"]*"|\w+) \. )*("[^"]*"|\w+) ADD (.*)', re.IGNORECASE)
_ENGINE = re.compile(r"\bENGINE (?:= )?(\w+)", re.IGNORECASE)
#: A name in a clause, whose tokens are parted by blanks and whose quoted names stand in double quotes.
_NAME = r'("[^"]*"|\w+)'
_LEVEL = rf"(?i)^(?:CONSTRAINT {_NAME} )?(?:PRIMARY KEY|FOREIGN KEY|UNIQUE|CHECK|EXCLUDE)(?: KEY| INDEX)?(?: {_NAME})? \(.*|^(?:FULLTEXT |SPATIAL )?(?:KEY|INDEX)(?: {_NAME})? \( (?:\"|[A-Za-z_]).*"
_KEYS = rf"(?i)^(?:CONSTRAINT {_NAME} )?({{}})(?: KEY| INDEX)?(?: {_NAME})? \( ((?:[^()]|\([^()]*\))*)\)"
_REFERENCES = rf"(?i)\bREFERENCES (?:{_NAME} \. )*{_NAME}(?: \( {_NAME})?"


def sql_dialect(ddl: Column) -> Column:
    """mysql or sqlite by their markers, else postgresql."""
    return F.when(ddl.rlike(r"(?i)ENGINE\s*=\s*InnoDB|AUTO_INCREMENT"), "mysql").when(ddl.rlike(r"(?i)\bAUTOINCREMENT\b|PRAGMA\s+"), "sqlite").otherwise("postgresql")


def universal_type(raw: Column) -> Column:
    """Universal type of a raw type; an unknown one stays, an empty one is TEXT."""
    t = F.trim(F.regexp_replace(F.upper(raw), r"\(.*\)$", ""))
    table = F.create_map(*[F.lit(x) for kind, names in UNIVERSAL.items() for name in names for x in (name, kind)])
    return F.coalesce(F.try_element_at(table, F.regexp_replace(t, r"\s+", " ")), F.nullif(t, F.lit("")), F.lit("TEXT"))


def native_type(universal: Column, dialect: str) -> Column:
    """A dialect's type for a universal type; TEXT if there is none."""
    table = F.create_map(*[F.lit(x) for pair in NATIVE[dialect].items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(universal)), F.lit("TEXT"))


# --- clauses ---------------------------------------------------------------------


def _statements(ddl: str) -> Iterator[list[str]]:
    """The tokens of each statement, without comments; literals are emptied, quoted names put in double quotes."""
    held: list[str] = []
    for m in _TOKEN.finditer(ddl):
        comment, literal, quoted, _ = m.groups()
        if comment:
            continue
        token = "''" if literal else '"' + m[0][1:-1].replace('"', "") + '"' if quoted else m[0]
        if token == ";":
            yield held
            held = []
        else:
            held.append(token)
    yield held


def _clauses(tokens: list[str]) -> tuple[list[dict], str]:
    """The clauses between the first brackets, parted at the commas that lie in no further ones, and what follows.

    A clause has all its tokens, and flat those outside of brackets.
    """
    depth, out, clause, flat = 0, [], [], []
    for i, t in enumerate(tokens):
        if t == ")":
            depth -= 1
        if not depth and t == ")" or depth == 1 and t == ",":
            if clause:
                out.append({"clause": " ".join(clause), "flat": " ".join(flat)})
            clause, flat = [], []
            if not depth:
                return out, " ".join(tokens[i + 1 :])
        elif depth:
            clause.append(t)
            if depth == 1 and t not in "()":
                flat.append(t)
        if t == "(":
            depth += 1
    if clause:
        out.append({"clause": " ".join(clause), "flat": " ".join(flat)})
    return out, ""


def ddl_tables(ddl: str) -> list[dict]:
    """The tables that a text creates, in order, with their clauses and those that ALTER statements add to the first table of a name."""
    out: list[dict] = []
    for tokens in _statements(ddl):
        # other statements may stand before without an end
        starts = [i for i, t in enumerate(tokens[:-1]) if t.upper() == "CREATE" or t.upper() == "ALTER" and tokens[i + 1].upper() == "TABLE"]
        for a, b in zip(starts, [*starts[1:], len(tokens)]):
            part = tokens[a:b]
            opened = part.index("(") if "(" in part else len(part)
            made = _CREATE.fullmatch(" ".join(part[:opened]))
            added = None if made else _ALTER.fullmatch(" ".join(part))
            if made and opened < len(part):
                clauses, rest = _clauses(part[opened:])
                engine = _ENGINE.search(rest)
                out.append({"table_no": len(out), "table_name": made[1].strip('"'), "engine": engine and engine[1], "clauses": clauses})
            elif added:
                table = next((t for t in out if t["table_name"] == added[1].strip('"')), None)
                if table:
                    table["clauses"].append({"clause": added[2], "flat": "ADD"})
    return out


# --- catalogs ----------------------------------------------------------------------


def _unquoted(name: Column) -> Column:
    return F.regexp_replace(name, '"', "")


def _named(clause: Column, kind: str) -> Column:
    """The columns that a table-level clause of a kind names."""
    inside = F.regexp_extract(clause, _KEYS.format(kind), 4)
    return F.transform(F.split(inside, " , "), lambda x: _unquoted(F.regexp_extract(x, f"^ ?{_NAME}", 1)))


def _reference(text: Column) -> Column:
    """(table, column) after REFERENCES, or null; a column that isn't named is id."""
    table = F.nullif(_unquoted(F.regexp_extract(text, _REFERENCES, 2)), F.lit(""))
    column = F.coalesce(F.nullif(_unquoted(F.regexp_extract(text, _REFERENCES, 3)), F.lit("")), F.lit("id"))
    return F.when(table.isNotNull(), F.struct(table.alias("table"), column.alias("column")))


def schema_catalog(files: DataFrame) -> DataFrame:
    """One row per column of every table created in the files (repo_id, path, source).

    repo_id, path, table_no, table_name, engine, dialect, pos, name, raw_type, type, pk, is_unique, nullable, ref_table,
    ref_column, auto_increment. Clauses of the table and ALTER statements count
    for the columns that they name. A null text, or one that creates no table,
    gives no rows. A small tokeniser parts texts into clauses, for brackets
    nest; what the clauses say is read by Spark, table by table, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{**same, **t} for same in batch.to_pylist() for t in ddl_tables(same.pop("source"))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    clause = pa.struct([("clause", pa.string()), ("flat", pa.string())])
    arrow = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("dialect", pa.string()), ("table_no", pa.int32()), ("table_name", pa.string()), ("engine", pa.string()), ("clauses", pa.list_(clause))])
    ddl = files.filter(F.col("source").rlike(r"(?i)CREATE\s[\s\w]*TABLE")).select("repo_id", "path", "source", sql_dialect(F.col("source")).alias("dialect"))
    tables = ddl.mapInArrow(run, f"repo_id string, path string, dialect string, {_TABLES}")
    column = rf"(?i)^{_NAME} (\w+(?: PRECISION\b| VARYING\b)?)(?: (\([^()]*\)))?"
    is_level = lambda c: c["clause"].rlike(_LEVEL) | (c["flat"] == "ADD")
    tables = tables.withColumns({"columns": F.filter("clauses", lambda c: ~is_level(c) & c["clause"].rlike(column)), "levels": F.transform(F.filter("clauses", is_level), lambda c: c["clause"])})
    keyed = lambda kind: F.flatten(F.transform("levels", lambda c: _named(c, kind)))
    referring = F.flatten(F.transform("levels", lambda c: F.transform(_named(c, "FOREIGN KEY"), lambda n: F.struct(n.alias("name"), _reference(c).alias("ref")))))
    tables = tables.withColumns({"primary": keyed("PRIMARY KEY"), "alone": keyed("UNIQUE"), "referring": F.filter(referring, lambda r: r["ref"].isNotNull())})
    each = tables.select("repo_id", "path", "table_no", "table_name", "engine", "dialect", "primary", "alone", "referring", F.posexplode("columns").alias("pos", "c"))
    has = lambda words: F.col("c.flat").rlike(rf'(?i)(?:^| ){words}(?: |$)')
    name = _unquoted(F.regexp_extract("c.clause", column, 1))
    raw = F.concat(F.regexp_extract("c.clause", column, 2), F.regexp_replace(F.regexp_replace(F.regexp_extract("c.clause", column, 3), " ", ""), ",", ", "))
    each = each.withColumns({"name": name, "raw_type": raw})
    last = F.element_at(F.concat(F.array(_reference(F.col("c.clause"))), F.transform(F.filter("referring", lambda r: r["name"] == F.col("name")), lambda r: r["ref"])), -1)
    pk = has("PRIMARY KEY") | F.array_contains("primary", F.col("name"))
    each = each.withColumns({"type": universal_type(F.col("raw_type")), "pk": pk, "ref": last})
    counted = has("AUTO_INCREMENT") | has("AUTOINCREMENT") | (F.col("dialect") == "sqlite") & (F.col("type") == "INTEGER") & has("PRIMARY KEY") | F.contains(F.upper("raw_type"), F.lit("SERIAL"))
    return each.select(
        "repo_id", "path", "table_no", "table_name", "engine", "dialect", "pos", "name", "raw_type", "type", "pk", (has("UNIQUE") | F.array_contains("alone", F.col("name"))).alias("is_unique"),
        (~has("NOT NULL") & ~F.col("pk")).alias("nullable"), F.col("ref.table").alias("ref_table"), F.col("ref.column").alias("ref_column"), counted.alias("auto_increment"),
    )


def cardinality(is_unique: Column) -> Column:
    """What a referring column stands for: one-to-one if it is unique, else one-to-many."""
    return F.when(is_unique, "one-to-one").otherwise("one-to-many")


def reference_map(keys: DataFrame, tables: DataFrame) -> DataFrame:
    """(repo_id, table_name, name, ref): what each referring column of a repository's tables refers to, as "table.column".

    Keys whose table or target is not among the tables (repo_id, table_name) are left out; of several targets
    of one column the first by name stays. Null columns refer to nothing.
    """
    known = tables.select("repo_id", "table_name").distinct()
    kept = keys.filter("src_column IS NOT NULL AND dst_column IS NOT NULL").join(known.withColumnRenamed("table_name", "src"), ["repo_id", "src"], "left_semi")
    kept = kept.join(known.withColumnRenamed("table_name", "dst"), ["repo_id", "dst"], "left_semi")
    return kept.groupBy("repo_id", F.col("src").alias("table_name"), F.col("src_column").alias("name")).agg(F.min(F.concat_ws(".", "dst", "dst_column")).alias("ref"))


def foreign_keys(catalog: DataFrame) -> DataFrame:
    """(repo_id, path, src, src_column, dst, dst_column, cardinality) of the columns that refer to a table."""
    kind = cardinality(F.col("is_unique"))
    return catalog.filter("ref_table IS NOT NULL").select("repo_id", "path", F.col("table_name").alias("src"), F.col("name").alias("src_column"), F.col("ref_table").alias("dst"), F.col("ref_column").alias("dst_column"), kind.alias("cardinality"))


def many_to_many(catalog: DataFrame) -> DataFrame:
    """(repo_id, path, junction, table_a, table_b): tables of exactly two plain references to two other tables."""
    refs = catalog.filter("ref_table IS NOT NULL").groupBy("repo_id", "path", "table_name")
    both = refs.agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_unique").alias("u"), F.min("ref_table").alias("table_a"), F.max("ref_table").alias("table_b"))
    own = "table_a <> table_name AND table_b <> table_name AND table_a <> table_b"
    return both.filter(f"n = 2 AND NOT u AND {own}").select("repo_id", "path", F.col("table_name").alias("junction"), "table_a", "table_b")


def export_ddl(catalog: DataFrame, dialect: str = "postgresql") -> DataFrame:
    """(repo_id, path, table_name, ddl): CREATE TABLE texts in a dialect, columns in their order."""
    q = "`" if dialect == "mysql" else '"'
    line = F.concat(
        F.lit(f"  {q}"), F.col("name"), F.lit(f"{q} "), native_type(F.col("type"), dialect),
        F.when(F.col("pk"), " PRIMARY KEY").otherwise(F.when(F.col("nullable"), "").otherwise(" NOT NULL")),
        F.when(F.col("is_unique") & ~F.col("pk"), " UNIQUE").otherwise(""),
        F.when(F.col("ref_table").isNotNull(), F.concat(F.lit(f" REFERENCES {q}"), F.col("ref_table"), F.lit(f"{q}({q}"), F.col("ref_column"), F.lit(f"{q})"))).otherwise(""),
    )
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    head = F.concat(F.lit(f"CREATE TABLE {q}"), F.col("table_name"), F.lit(f"{q} (\n"))
    return catalog.groupBy("repo_id", "path", "table_name").agg(lines.alias("lines")).select("repo_id", "path", "table_name", F.concat(head, F.array_join("lines", ",\n"), F.lit("\n);")).alias("ddl"))
