"""Catalog of endpoints with the request bodies that validation schemas ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions.contain import contained
from reposcope.functions.text import keep_first, positions, union
from reposcope.operators.scan import KEYS
from reposcope.sources.tables import written

# Fields of a validation schema, signs of a required one and how far they may stand, and what makes a text a schema.
FIELD = r"(\w+):\s*z\.(string|number|boolean|email|array|object|date|uuid)"
REQUIRED, REQUIRED_CHARS = [".min(", "required"], 100
SCHEMA_SIGNS = ["z.", "yup."]
# Fields that are supposed where a schema shows none: words of the text, field, type, required. Later rules replace the fields of earlier ones.
SUPPOSED = [
    (["login", "signin"], "email", True),
    (["login", "signin"], "password", True),
    (["register", "signup", "create"], "email", True),
    (["register", "signup", "create"], "password", True),
    (["register", "signup", "create"], "name", False),
    (["user", "profile"], "email", True),
    (["user", "profile"], "name", False),
]
BODY_METHODS = ["POST", "PUT", "PATCH"]


def schema_field_rows(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, type, required): the fields of a file's schemas, of equal names the last.

    A field is required if a minimum or the word stands in the 100 characters
    from its name on. A file without fields has those that its words suppose.
    """
    found = positions(files.select(*KEYS, "source"), FIELD, after=REQUIRED_CHARS)
    kind = F.regexp_extract("match", FIELD, 2)
    rows = found.select(
        *KEYS,
        F.regexp_extract("match", FIELD, 1).alias("name"),
        (-F.col("at")).alias("order"),
        F.when(kind == "email", "string").otherwise(kind).alias("type"),
        _has(F.col("rest"), REQUIRED).alias("required"),
    )
    stated = keep_first(rows, [*KEYS, "name"], ["order", "type"]).select(*KEYS, "name", "type", "required")
    low = F.lower("source")
    array = F.array_compact(F.array(*[F.when(_has(low, words), F.struct(F.lit(name).alias("name"), F.lit(needed).alias("required"))) for words, name, needed in SUPPOSED]))
    none = files.filter(~F.col("source").rlike(FIELD))
    supposed = none.select(*KEYS, F.explode(array).alias("f")).select(*KEYS, "f.name", F.lit("string").alias("type"), "f.required").distinct()
    return stated.unionByName(supposed)


def _has(text: Column, words: list[str]) -> Column:
    return F.array_contains(F.array(*[F.contains(text, F.lit(w)) for w in words]), True)


def endpoint_catalog(controllers: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, method, route, name, path, schema_path, body, fields): one row per controller (repo_id, route, path, methods) and method.

    schema_path is the first file with a validation schema whose text holds the
    route or whose path, in lower case, holds the controller's folder; body tells
    what the request carries: login (of a handler without methods), schema (with
    fields, as name:type and ! if required), default or none.
    """
    each = controllers.withColumn("method", F.explode(F.split("methods", ",")))
    named = F.when(F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2) != "", F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2))
    each = written(each.select("repo_id", "route", "path", "method", F.coalesce(named, F.element_at(F.split("path", "/"), -1)).alias("folder")).distinct())
    asked = each.filter("method <> 'HANDLER'")
    schemas = files.filter(_has(F.col("source"), SCHEMA_SIGNS))
    by_text = contained(schemas.select("repo_id", "path", "source"), "source", asked.select("repo_id", "route"), "route").groupBy("repo_id", "route").agg(F.min("path").alias("by_text"))
    by_path = contained(schemas.select("repo_id", "path", F.lower("path").alias("where")).distinct(), "where", asked.select("repo_id", "folder"), "folder").groupBy("repo_id", "folder").agg(F.min("path").alias("by_path"))
    met = asked.join(by_text, ["repo_id", "route"], "left").join(by_path, ["repo_id", "folder"], "left").withColumn("schema_path", F.least("by_text", "by_path"))
    used = met.select("repo_id", F.col("schema_path").alias("path")).filter("path IS NOT NULL").distinct()
    field = F.concat("name", F.lit(":"), "type", F.when(F.col("required"), "!").otherwise(""))
    fields = schema_field_rows(schemas.join(used, KEYS, "left_semi")).groupBy(*KEYS).agg(F.array_join(F.sort_array(F.collect_list(field)), ",").alias("fields"))
    full = met.join(fields.withColumnRenamed("path", "schema_path"), ["repo_id", "schema_path"], "left")
    body = F.when(F.col("fields").isNotNull(), "schema").when(F.col("method").isin(BODY_METHODS), "default").otherwise("none")
    shown = full.select("repo_id", "method", "route", F.concat_ws(" ", "method", "route").alias("name"), "path", "schema_path", body.alias("body"), F.coalesce("fields", F.lit("")).alias("fields"))
    nothing = F.lit(None).cast("string")
    handlers = each.filter("method = 'HANDLER'").select("repo_id", F.lit("POST").alias("method"), "route", F.concat_ws(" ", "method", "route").alias("name"), "path", nothing.alias("schema_path"), F.lit("login").alias("body"), F.lit("email:string!,password:string!").alias("fields"))
    return union([shown, handlers])
