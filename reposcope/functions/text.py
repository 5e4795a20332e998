"""Findings in source texts by regular expressions, with their line numbers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unmarked(text: Column) -> Column:
    """A text without the control characters that `findings` and `positions` mark matches with."""
    return F.regexp_replace(text, "[\x01-\x03]", "")


def positions(files: DataFrame, pattern: str, source: str = "source", before: int = 0, after: int = 0) -> DataFrame:
    """One row per match: the table's other columns, match, at (characters before it), line, lead and rest.

    lead is up to `before` characters that end where the match begins, rest up to
    `after` characters from there on. Spark marks the matches in place by one
    replacement; a running count over the marked text then gives every match
    its place, line and surroundings, so that a row holds no more of the text than
    these and a file costs time and memory in proportion to its length.
    """
    keys = [c for c in files.columns if c != source]
    marked = F.regexp_replace(unmarked(F.col(source)), pattern, "\x01$0\x02")
    rows = files.select(*[F.col(k) for k in keys], marked.alias("text_marked")).filter(F.contains("text_marked", F.lit("\x01")))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                yield from matched(batch.slice(i, 1), text)

    def matched(row: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
        pieces = text.split("\x01")
        plain = "".join(pieces).replace("\x02", "")
        at, line, out = len(pieces[0]), 1 + pieces[0].count("\n"), []
        for piece in pieces[1:]:
            match, _, rest = piece.partition("\x02")
            out.append((match, at, line, plain[max(at - before, 0) : at], plain[at : at + after]))
            if len(out) == 10_000:
                yield batch_of(row, out)
                out = []
            at += len(match) + len(rest)
            line += piece.count("\n")
        if out:
            yield batch_of(row, out)

    def batch_of(row: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        same = pa.array([0] * len(out))
        found = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays([*(row.column(k).take(same) for k in range(len(keys))), *found], [*keys, "match", "at", "line", "lead", "rest"])

    return rows.mapInArrow(run, f"{kinds}match string, at int, line int, lead string, rest string")


def positions_sql(pattern: str, table: str = "modules", keys: str = "repo_id, path", source: str = "source") -> str:
    """The same positions for DuckDB."""
    quoted = pattern.replace("'", "''")
    return f"""(SELECT {keys}, src AS source, string_split(piece, chr(2))[1] AS match, spot, CAST(1 + length(regexp_replace(left(src, spot), '[^\\n]', '', 'g')) AS INTEGER) AS line FROM (
      SELECT {keys}, src, pieces[k] AS piece, CAST(list_sum(list_transform(pieces[:k - 1], lambda x: length(replace(x, chr(2), '')))) AS INTEGER) AS spot FROM (
        SELECT {keys}, src, pieces, unnest(generate_series(2, len(pieces))) AS k FROM (
          SELECT {keys}, {source} AS src, string_split(regexp_replace({source}, '{quoted}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS pieces FROM {table}))))"""


def findings(files: DataFrame, pattern: str, groups: int = 1, source: str = "source") -> DataFrame:
    """One row per match: the table's other columns, line, and found, an array of the captured groups.

    Matches are marked in place by one replacement, so that splitting at line
    ends gives each match its line; the pass is linear in the text and needs no
    shuffle. Captured groups must not span lines. The control characters used as
    marks are taken out of the text first, so that none can be forged.
    """
    marks = "\x03".join(f"${g}" for g in range(1, groups + 1))
    lines = F.split(F.regexp_replace(unmarked(F.col(source)), pattern, f"\x01{marks}\x02$0"), "\n")
    keys = [c for c in files.columns if c != source]
    marked = files.select(*keys, F.posexplode(lines).alias("at", "text"))
    hits = F.regexp_extract_all("text", F.lit("\x01([^\x02]*)\x02"), F.lit(1))
    return marked.select(*keys, (F.col("at") + 1).alias("line"), F.explode(hits).alias("hit")).withColumn("found", F.split("hit", "\x03")).drop("hit")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in `order`; minima combine before the shuffle, so hot keys are harmless."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, *[f"first.{c}" for c in [*order, *rest]]).select(*df.columns)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _alternatives(pattern: str) -> list[str]:
    """What stands between the bars of a pattern that lie in no brackets."""
    parts, depth, listed, at = [""], 0, False, 0
    while at < len(pattern):
        c = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        at += len(c)
        if c == "|" and not depth and not listed:
            parts.append("")
            continue
        listed = c != "]" if listed else c == "["
        depth += 0 if listed else {"(": 1, ")": -1}.get(c, 0)
        parts[-1] += c
    return parts


def _beginning(pattern: str) -> tuple[str, bool]:
    """The plain characters that every match of a pattern without bars begins with, and whether they are all of it."""
    found, at = "", 0
    while at < len(pattern):
        c = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        follows = pattern[at + len(c) : at + len(c) + 1]
        if c in set(".^$[](){}|?*+") or (len(c) == 2 and c[1].isalnum()) or follows in {"?", "*", "{"}:
            return found, False
        found, at = found + c[-1], at + len(c)
        if follows == "+":
            return found, False
    return found, True


def matches(text: Column, pattern: str) -> Column:
    """What `text.rlike(pattern)` says, for long lists of signs: each alternative is looked for only in texts that hold the characters it begins with."""
    asked = []
    for part in _alternatives(pattern):
        start, whole = _beginning(part)
        held = F.contains(text, F.lit(start))
        asked.append(held if whole else held & text.rlike(part) if start else text.rlike(part))
    return reduce(Column.__or__, asked)


def findings_sql(pattern: str, groups: int = 1, table: str = "modules", keys: str = "repo_id, path", source: str = "source") -> str:
    """The same findings for DuckDB: keys, line and found1, found2, …"""
    marks = " || chr(3) || ".join([f"'\\{g}'" for g in range(1, groups + 1)])
    quoted = pattern.replace("'", "''")
    parts = ", ".join(f"string_split(hit, chr(3))[{g}] AS found{g}" for g in range(1, groups + 1))
    return f"""(SELECT {keys}, line, {parts} FROM (SELECT {keys}, line, unnest(regexp_extract_all(text, '\\x01([^\\x02]*)\\x02', 1)) AS hit FROM (
      SELECT {keys}, generate_subscripts(a, 1) AS line, unnest(a) AS text FROM (
        SELECT {keys}, string_split(regexp_replace({source}, '{quoted}', chr(1) || {marks} || chr(2) || '\\0', 'g'), chr(10)) AS a FROM {table}) AS s) AS m) AS h)"""
