"""Journey signals by hand-written cases."""

from test_reference import files, spark  # noqa: F401

from reposcope.operators import journey

LAYOUT = "import Home from './home/page'\nimport X from './globals'\nimport Up from '../shop'\nimport R from 'react'"
LINKS = "router.push('/Cart'); <Link href=\"/about\"> <a href='#top'> <link rel=x href='#a'>"


def signals(found, path):
    row = next(r for r in found if r.path == path)
    return {k for k in [*journey.SIGNALS, "external_service"] if row[k]}, row


def test_signals_of_files(spark):  # noqa: F811
    made = files(spark, *{
        "app/page.tsx": "", "app/layout.tsx": LAYOUT, "app/shop/page.tsx": LINKS, "pages/u/[id].tsx": "Sign Out", "pages/api/order.ts": "db.insert(x) // place",
        "package.json": '{"dependencies": {"next-auth": "4"}, "devDependencies": {"ioredis": "5"}}', "x/package.json": "{broken", "middleware.ts": "const a = Stripe (key)",
        "lib/errorTools.ts": "a", "Error/a.ts": "a", "none.ts": None, "app/api/profile/route.ts": "export async function PUT(r) { editProfile(r) }",
    }.items())
    found = journey.journey_signals(made).filter("repo_id = 'r1'").collect()
    assert len(found) == 12
    assert signals(found, "app/page.tsx")[0] == {"landing"}
    kinds, row = signals(found, "app/layout.tsx")
    assert "landing" in kinds and row.route == "/home/page" and row.decisions == ["/home/page", "/shop"]
    row = signals(found, "app/shop/page.tsx")[1]
    assert (row.route, row.decisions, row.crud) == ("/shop", ["#a", "/about", "/cart"], "API")
    kinds, row = signals(found, "pages/u/[id].tsx")
    assert kinds == {"logout"} and row.route == "/u/:id:"
    kinds, row = signals(found, "pages/api/order.ts")
    assert kinds == {"api"} and row.route is None and row.crud == "CREATE" and [s.trigger for s in row.stores] == ["place order"]
    assert signals(found, "package.json")[0] == {"auth", "cache"} and signals(found, "x/package.json")[0] == set()
    kinds, row = signals(found, "middleware.ts")
    assert kinds == {"middleware", "external_service"} and row.services == ["stripe"]
    assert signals(found, "lib/errorTools.ts")[0] == {"error_handler"} and signals(found, "Error/a.ts")[0] == set()
    kinds, row = signals(found, "none.ts")
    assert kinds == set() and row.decisions == row.services == row.stores == []
    row = signals(found, "app/api/profile/route.ts")[1]
    assert row.crud == "UPDATE" and [tuple(s) for s in row.stores] == [("update profile", "profile updated", "update record")]


def test_repeated_rows_long_texts_and_empty_tables(spark):  # noqa: F811
    long = "x" * 300_000 + " login " + "'" * 100_000
    made = files(spark, ("a.ts", long), ("a.ts", long))
    found = journey.journey_signals(made).filter("repo_id = 'r1'").collect()
    assert len(found) == 1 and found[0].auth
    assert journey.journey_signals(made.limit(0)).count() == 0


def test_signs_are_asked_only_where_their_letters_are(spark):  # noqa: F811
    from pyspark.sql import functions as F

    from reposcope.functions.text import matches

    texts = ["", "a|b", "xab", "lo  gin", "fo(o", "z.  object(", "q{", "bulk.", "bull.", "aab", "ac"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in [r"a\|b|xa", r"lo\s*gin|fo\(o", r"z\.\s*(?:object|x)\s*\(|bull\.", r"[|a]b|q\{", r"a+b|ab?c", r"\w+\.|try\s*\{"]:
        assert rows.filter(matches(F.col("t"), pattern) != F.col("t").rlike(pattern)).count() == 0
    plan = journey.journey_signals(files(spark, ("a.ts", "x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE sendgrid" not in plan and "Contains(" in plan
