"""Routes and candidates of one repository meet by what they share, and not each with each."""

import time

from pyspark.sql import functions as F
from test_reference import first, spark  # noqa: F401

from reposcope.functions.paths import route_pattern
from reposcope.operators import link, navigation

MANY = 20_000


def test_patterns_of_all_kinds_fit_as_each_with_each(spark):  # noqa: F811
    routes = ["/users/:id", "/users/:id/:tab", "/:a/:b", "/a.b/:x", "/a/:x*/b", "/a/:x?", "/:x*/m/:y*", "/a/[:x]", "/p/:id.json", "/q|r/:x", "/:x", "/a/*/:x", "/(a)/:x"]
    asked = ["/users/1", "/users/1/edit", "/a.b/1", "/axb/1", "/a/c/b", "/a/1", "/a", "/p/q/m", "/a/c", "/p/7.json", "/q", "/r/1", "/a//1", "/", "", "x/y"]
    c = spark.createDataFrame([("r1", x) for x in asked] + [("r2", "/users/1"), ("r1", None)], "repo_id string, candidate string")
    r = spark.createDataFrame([("r1", x) for x in routes], "repo_id string, route string")
    segments = lambda x: F.size(F.split(x, "/"))
    wanted = c.join(r, "repo_id").filter((segments("candidate") == segments("route")) & F.rlike("candidate", route_pattern(F.col("route"))))
    assert first(link.fitting(c, r), "candidate", "route") == first(wanted, "candidate", "route")


def test_many_candidates_and_routes_of_one_repository(spark):  # noqa: F811
    n = F.col("id").cast("string")
    c = spark.range(MANY).select(F.lit("r1").alias("repo_id"), F.concat(F.lit("/users/9/w"), n).alias("candidate"))
    r = spark.range(MANY // 2, MANY * 2).select(F.lit("r1").alias("repo_id"), F.concat(F.lit("/users/:id/w"), n).alias("route"))
    start = time.time()
    assert link.match_routes(c, r).groupBy("rung").count().collect() == [(2, MANY // 2)]
    # the others take the first route of the same static part that shares enough characters
    found = dict(navigation.similar_routes(c, r).groupBy("rung").count().collect())
    assert found[3] == MANY // 2 and found[4] > 0
    assert time.time() - start < 60
