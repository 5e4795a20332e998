"""Token classes of hand-written texts."""

import pytest
from test_reference import spark  # noqa: F401

from reposcope.operators.lexical import CLASSES, token_classes

# text, language, keywords, identifiers, operators, strings, numbers, punctuation, comments, scopes
CASES = [
    ("const a = 1 + 2.5e3;", "javascript", 1, 1, 2, 0, 2, 1, 0, 0),
    ("// note\nlet s = 'it\\'s' + \"x\\\\\" /* and\n more */ + `t${a}\n`", "javascript", 1, 1, 3, 3, 0, 0, 2, 0),
    ("if (a === b && c !== d) { return {...e} } else { f?.g(h ?? 0x1F) }", "javascript", 3, 8, 6, 0, 1, 5 - 1, 0, 6),
    ("a >>>= b ** -c; d => e[0].f", "javascript", 0, 6, 5, 0, 1, 4, 0, 0),
    ("/*/ x", "javascript", 0, 1, 0, 0, 0, 0, 1, 0),
    ("'never ends // no comment", "javascript", 0, 0, 0, 1, 0, 0, 0, 0),
    ("a /* never ends 'x'", "javascript", 0, 1, 0, 0, 0, 0, 1, 0),
    ("x = '\\", "javascript", 0, 1, 1, 1, 0, 0, 0, 0),
    ("  create table t (id INT Primary Key, -- the key\n n text default 'a--b'); // c", "sql", 5, 5, 0, 1, 0, 4, 2, 0),
    ("a -- b", "javascript", 0, 2, 1, 0, 0, 0, 0, 0),
    ("café § naïve #$x @y \\", "javascript", 0, 5, 0, 0, 0, 3, 0, 0),
    ("1_000 .5 1..2 ...z", "javascript", 0, 1, 1, 0, 3, 0, 0, 0),
    (None, "javascript", 0, 0, 0, 0, 0, 0, 0, 0),
    ("", "javascript", 0, 0, 0, 0, 0, 0, 0, 0),
]


@pytest.fixture(scope="module")
def counted(spark):  # noqa: F811
    rows = spark.createDataFrame([(k, c[0], "x") for k, c in enumerate(CASES)], "k int, source string, letters string")
    return {r["k"]: tuple(r[c] for c in ("language", *CLASSES)) for r in token_classes(rows, ["k"]).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_classes(counted, k):
    assert counted[k] == CASES[k][1:]


def test_long_strings_and_empty_tables(spark):  # noqa: F811
    rows = spark.createDataFrame([(1, "'" + "a\\'" * 200_000 + "' b /*" + "*" * 200_000), (2, "x" * 300_000)], "k int, source string")
    got = {r["k"]: (r["strings"], r["identifiers"], r["comments"]) for r in token_classes(rows, ["k"]).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 1, 0)} and token_classes(rows.limit(0), ["k"]).count() == 0
