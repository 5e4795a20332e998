"""Containment index and match positions against plain versions."""

import random
import re
import time

import pytest
from test_reference import files, spark  # noqa: F401

from reposcope.functions import contain
from reposcope.functions.text import positions
from reposcope.operators import match, navigation


def some_texts(rng):
    word = lambda n: "".join(rng.choice("abé/") for _ in range(n))
    texts = [(f"r{rng.randrange(3)}", i, word(rng.randrange(300))) for i in range(150)] + [("r0", 999, None), (None, 1000, "abc"), ("r1", 1001, ""), ("r1", 1001, "")]
    needles = [(f"r{rng.randrange(3)}", word(rng.choice([1, 2, 3, 4, 6]))) for _ in range(120)] + [("r0", ""), ("r0", None), (None, "a")]
    for _ in range(60):
        repo, _, text = rng.choice(texts[:150])
        if len(text) > 10:
            a, n = rng.randrange(len(text) - 8), rng.choice([40, 63, 64, 65, 100, 200])
            needles += [(repo, text[a : a + n]), (repo, text[a : a + n] + "x"), (repo, text[a : a + n])]
    return texts, needles


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contained_equals_all_pairs(spark, monkeypatch, block):  # noqa: F811
    monkeypatch.setattr(contain, "BLOCK", block)
    texts, needles = some_texts(random.Random(block))
    want = {(r, i, n) for r, i, t in texts for r2, n in needles if r is not None and r == r2 and t and n and n in t}
    found = contain.contained(spark.createDataFrame(texts, "repo_id string, i int, t string"), "t", spark.createDataFrame(needles, "repo_id string, n string"), "n").collect()
    assert len(found) == len(want) and {tuple(x) for x in found} == want


def test_nothing_is_contained_in_nothing(spark):  # noqa: F811
    texts, needles = spark.createDataFrame([("r", 1, "abc")], "repo_id string, i int, t string"), spark.createDataFrame([("r", "b")], "repo_id string, n string")
    assert contain.contained(texts.limit(0), "t", needles, "n").count() == contain.contained(texts, "t", needles.limit(0), "n").count() == 0


def test_large_source_with_many_needles(spark):  # noqa: F811
    rng = random.Random(2)
    source = "".join(rng.choice("abcdefghij/ (){}\n") for _ in range(1_500_000))
    tables = [("r", f"t{k}", source[k * 900 : k * 900 + 8 + k % 40]) for k in range(1500)] + [("r", f"u{k}", f"/absent/{k}") for k in range(3000)]
    began = time.time()
    found = match.contains_join(spark.createDataFrame([("r", "big.ts", source)], "repo_id string, path string, low string"), "low", spark.createDataFrame(tables, "repo_id string, dst string, name string"), "name")
    assert {r["dst"] for r in found.collect()} == {f"t{k}" for k in range(1500)} and time.time() - began < 30


def test_positions(spark):  # noqa: F811
    text = 'é<a href="x">\n<a href="y">é\n\n <a href="z"> \x01\x02 end'
    got = positions(files(spark, ("p", text), ("q", None), ("s", "none")), r"<a[^>]*>", before=3, after=8).filter("repo_id = 'r1'").collect()
    clean = re.sub("[\x01-\x03]", "", text)
    want = [("p", m.group(), m.start(), 1 + clean[: m.start()].count("\n"), clean[max(m.start() - 3, 0) : m.start()], clean[m.start() : m.start() + 8]) for m in re.finditer(r"<a[^>]*>", clean)]
    assert sorted((r["path"], r["match"], r["at"], r["line"], r["lead"], r["rest"]) for r in got) == sorted(want)


def test_many_positions_of_a_large_file(spark):  # noqa: F811
    source = "".join(f'<a href="/users/{i}/settings">a text of some length for the link</a>\n' for i in range(20_000))
    made = spark.createDataFrame([("r", "a.tsx", source)], "repo_id string, path string, source string")
    began = time.time()
    assert navigation.scan_route_refs(made).count() == 40_000 and time.time() - began < 60
    row = navigation.scan_route_refs(made).filter("line = 15000 AND type = 'explicit'").collect()[0]
    at = source.index('<a href="/users/14999/')
    assert row["literal"] == "/users/14999/settings" and row["context"] == re.sub(r"\s+", " ", source[at - 50 : at + 50]).strip()


def test_views_of_one_label_meet_a_file_as_one(spark, monkeypatch):  # noqa: F811
    views = [("r1", f"/orders/v{i:03}", "/orders") for i in range(200)] + [("r1", "/users/a", "/users"), ("r1", "/none", None), ("r9", "/orders/z", "/orders")]
    sent = files(spark, *[(f"app/orders/f{i}.tsx", "new FormData()") for i in range(30)], ("app/users/orders.tsx", "FormData"), ("app/users/x.tsx", "text"), ("app/users/y.tsx", "x.upload("))
    met, join = [], match.contains_join
    monkeypatch.setattr(match, "contains_join", lambda *a: met.append(join(*a)) or met[-1])
    made = spark.createDataFrame(views, "repo_id string, node_id string, label string")
    got = match.upload_edges(sent, made, spark.createDataFrame([("r1", "d2"), ("r1", "d1")], "repo_id string, node_id string"))
    assert sorted((r["src"], r["dst"]) for r in got.collect()) == [("/orders/v000", "d1"), ("/users/a", "d1")]
    # a row for each file and label, not for each file and view
    assert met[0].filter("repo_id = 'r1'").count() == 30 + 2 + 1
