"""File trees as tables."""

import pytest
from test_reference import files, first, spark  # noqa: F401

from reposcope.sources import tables
from reposcope.sources.tables import read_modules, write_modules


def test_tree(spark, tmp_path):  # noqa: F811
    texts = {"one/app/page.tsx": "export é\n", "one/a b+c.ts": "x", "two/empty.ts": "", "two/deep/er/one/y.ts": "1\r\n2", "two/big.ts": "z" * 300}
    for path, text in texts.items():
        (tmp_path / "root" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / path).write_bytes(text.encode())
    (tmp_path / "root" / "two" / "bad.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "root" / "two" / "_hidden.ts").write_text("no")
    got = sorted(map(tuple, read_modules(spark, f"{tmp_path}/root/", most=200).collect()))
    texts.pop("two/empty.ts")
    want = [(p.split("/", 1)[0], p.split("/", 1)[1], None if "big" in p else t, "too large" if "big" in p else None) for p, t in texts.items()] + [("two", "bad.bin", None, "not text")]
    assert got == sorted(want)
    assert {r["path"] for r in read_modules(spark, f"{tmp_path}/root", "r").filter("repo_id = 'r' AND problem IS NULL").collect()} == set(texts)


def test_written_tree_has_one_file_for_each_text_where_its_path_says(spark, tmp_path):  # noqa: F811
    paths = ["app/(main)/a b/page.tsx", "app/x/[id]/form%2F.tsx", "lib/é=1.ts", "top.sql"]
    rows = [(r, p, f"{p}\n2 {r}") for r in ("one", "two") for p in paths]
    write_modules(spark.createDataFrame(rows, "repo_id string, path string, source string"), f"{tmp_path}/tree")
    # no folder, mark or checksum beside the files: each cost a process or more for a single text
    assert {str(f.relative_to(tmp_path / "tree")): f.read_text() for f in (tmp_path / "tree").rglob("*") if f.is_file()} == {f"{r}/{p}": s for r, p, s in rows}
    got = read_modules(spark, f"{tmp_path}/tree").collect()
    assert sorted((r["repo_id"], r["path"], r["source"]) for r in got) == sorted(rows)
    with pytest.raises(Exception, match="no path inside"):
        write_modules(spark.createDataFrame([("one", "../out.ts", "x")], "repo_id string, path string, source string"), f"{tmp_path}/tree")


def test_registered_tree_equals_its_texts(spark):  # noqa: F811
    from reposcope.plans.composed import _tree

    table = files(spark, ("a/b.ts", "x"), ("a/b.ts", "w\n"), ("c.ts", "y\n\n"))
    got = first(_tree(table), "path", "source", "problem")
    assert got == [("a/b.ts", "w\n", None), ("c.ts", "y\n\n", None)]


def test_folders_are_listed_by_tasks_and_not_by_the_driver(spark, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.setattr(tables, "FILES", 3)
    texts = {f"r{r}/a{i}/b c/{'/'.join('de'[:i % 3])}/f{i}.ts": f"{r} {i}" for r in (1, 2) for i in range(12)} | {f"r1/flat/g{i}.ts": str(i) for i in range(9)}
    for path, text in texts.items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(text)
    (tmp_path / "tree" / "r1" / ".git").mkdir()
    (tmp_path / "tree" / "r1" / ".git" / "x.ts").write_text("no")
    got = read_modules(spark, f"{tmp_path}/tree")
    assert {f"{r['repo_id']}/{r['path']}": r["source"] for r in got.collect()} == {str(tables.re.sub("/+", "/", p)): t for p, t in texts.items()} and got.count() == len(texts)
    # Spark's reader holds every file's status on the driver
    assert not [f for f in got.inputFiles() if f.endswith(".ts")]
