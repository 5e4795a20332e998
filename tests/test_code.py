"""Line rules of several languages: how often they are applied, and what they find in odd lines."""

from test_reference import spark  # noqa: F401

from reposcope.operators import code

TEXT = "// class No {\n@Get(\"/a\")\npublic class A extends B<C> {\n    int size(int x) {\n    if (x) {\n}\n"


def test_each_rule_is_applied_once(spark):  # noqa: F811
    files = spark.createDataFrame([("r", "src/A.java", TEXT), ("r", "b.txt", TEXT), ("r", "c.py", None), ("r", "d.py", "class D:")], "repo_id string, path string, source string")
    found = code.symbols(files)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the rules, and the signs of comments
    assert plan.upper().count("RLIKE") <= sum(map(len, code.RULES.values())) + 1
    got = sorted((r.path, r.line, r.kind, r.name, r.rest, r.owner) for r in found.collect())
    assert got == [("d.py", 1, "class", "D", "", None), ("src/A.java", 2, "annotation", "Get", '"/a"', None), ("src/A.java", 3, "class", "A", "B<C>", None), ("src/A.java", 4, "function", "size", "int x", "A")]


def test_symbols_of_a_unified_graph_are_found_once(spark):  # noqa: F811
    files = spark.createDataFrame([("r", "d.py", "class D(E):\n    def f(self):\n        return self.g()\n    def g(self):\n        pass")], "repo_id string, path string, source string")
    imports = spark.createDataFrame([], "repo_id string, path string, target string")
    _, edges = code.unified_graph(files, imports)
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("abstract") == 0
    assert sorted(map(tuple, edges.collect())) == [("r", "d.py#D", "d.py#E", "inherit"), ("r", "d.py#D.f", "d.py#D.g", "reference")]
