"""Lexical classes of source texts, counted in place: no row per token and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of each language that are keywords, signs of several characters (the longer first), and signs that punctuate.
JS_KEYWORDS = """const let var function return if else for while do switch case break continue new class extends import export from default async await try catch finally throw typeof instanceof in of delete void
yield static get set public private protected readonly interface type enum namespace module declare abstract implements as is satisfies infer keyof unique""".split()
SQL_KEYWORDS = """CREATE TABLE ALTER DROP SELECT INSERT UPDATE DELETE FROM WHERE JOIN INNER LEFT RIGHT OUTER ON AND OR NOT NULL PRIMARY KEY FOREIGN REFERENCES UNIQUE DEFAULT CHECK CONSTRAINT INDEX VIEW DATABASE SCHEMA
GRANT REVOKE COMMIT ROLLBACK BEGIN END IF ELSE THEN CASE WHEN AS ORDER BY ASC DESC LIMIT OFFSET GROUP HAVING UNION ALL DISTINCT INTO VALUES SET RETURNS FUNCTION PROCEDURE TRIGGER DECLARE LANGUAGE SECURITY DEFINER INVOKER
RETURN EXECUTE EXEC""".split()
OPERATORS = "=== !== >>> **= >>= <<= &&= ||= ??= == != <= >= && || => ++ -- += -= *= /= %= &= |= ^= << >> ?? ?. ... ** + - * / % = < > ! ? : & | ^ ~".split()
PUNCTUATION = "( ) [ ] ; , . @ # \\".split()
SQL_SIGNS = [r"(?i)^\s*(?:create\s+table|select\s|insert\s|update\s|delete\s|alter\s|drop\s)", r"(?i)primary key|foreign key|references"]

_QUOTED = "|".join(rf"{q}(?:[^{q}\\]|\\[\s\S]?)*+(?:{q}|\z)" for q in ("\"", "'", "`"))
_COMMENT = r"//[^\n]*|/\*/|/\*[\s\S]*?(?:\*/|\z)"
_SIGNS = "|".join("".join(f"\\{c}" for c in s) for s in [*OPERATORS, *PUNCTUATION])
_REST = rf"{_QUOTED}|(?:\d|\.\d)[\d.eExXa-fA-F_]*|[a-zA-Z_$][a-zA-Z0-9_$]*|[{{}}]|{_SIGNS}"
#: One token: comments first, then strings, numbers, words, scopes and signs; other characters are passed over.
JS_TOKEN, SQL_TOKEN = f"{_COMMENT}|{_REST}", rf"{_COMMENT}|--[^\n]*|{_REST}"
#: The classes and the letters that stand for them while they are counted.
CLASSES = {"keywords": "k", "identifiers": "i", "operators": "o", "strings": "s", "numbers": "n", "punctuation": "p", "comments": "c", "scopes": "b"}


def is_sql(text: Column) -> Column:
    """Whether a text is SQL: by how it begins or by words of keys."""
    return F.rlike(F.trim(text), F.lit(SQL_SIGNS[0])) | F.rlike(text, F.lit(SQL_SIGNS[1]))


def _class(token: Column, keywords: list[str], upper: bool, comments: list[str]) -> Column:
    word = F.upper(token) if upper else token
    comment = F.array_contains(F.array(*[F.startswith(token, F.lit(c)) for c in comments]), True)
    head = F.left(token, F.lit(1))
    return (
        F.when(comment, "c")
        .when(head.isin("'", '"', "`"), "s")
        .when(token.rlike(r"^\.?\d"), "n")
        .when(head.rlike("[a-zA-Z_$]"), F.when(word.isin(keywords), "k").otherwise("i"))
        .when(head.isin("{", "}"), "b")
        .when(token.isin(PUNCTUATION), "p")
        .otherwise("o")
    )


def token_classes(files: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    """(keys, language, and the number of tokens of each class in `CLASSES`) of each text; sql or javascript by its signs.

    A string or comment that does not end goes to the end of the text. A null or
    empty text has no tokens.
    """
    text = F.coalesce(F.col(source), F.lit(""))
    tokens = lambda pattern, *how: F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: _class(t, *how)), "")
    sql = is_sql(text)
    letters = F.when(sql, tokens(SQL_TOKEN, SQL_KEYWORDS, True, ["//", "/*", "--"])).otherwise(tokens(JS_TOKEN, JS_KEYWORDS, False, ["//", "/*"]))
    rows = files.select(*keys, F.when(sql, "sql").otherwise("javascript").alias("language"), letters.alias("letters"))
    return rows.select(*keys, "language", *[F.regexp_count("letters", F.lit(k)).cast("long").alias(name) for name, k in CLASSES.items()])
