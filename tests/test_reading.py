"""Reading order and navigation of pages with the files they import."""

import random

from test_reference import files, first, spark  # noqa: F401

from reposcope.operators.reading import page_graph, reading_order


def read_in_turn(page, texts, imports, depth):
    """The files met from a page by following each import at once, with the lines before each."""
    out, seen, lines = [], set(), 0

    def visit(path, far):
        nonlocal lines
        if far > depth or path in seen:
            return
        seen.add(path)
        if not texts.get(path):
            return
        out.append((path, len(out), lines))
        lines += texts[path].count("\n") + 2
        for t in imports.get(path, []):
            visit(t, far + 1)

    visit(page, 0)
    return out


def test_order_equals_a_recursive_reader(spark):  # noqa: F811
    rng, rows, want = random.Random(7), [], {}
    for r in range(12):
        names = [f"src/f{k}.tsx" for k in range(rng.randrange(3, 16))]
        imports = {n: rng.sample(names, rng.randrange(0, min(4, len(names)))) for n in names}
        texts = {n: "".join(f'import A{i} from "./{t[4:-4]}";\n' for i, t in enumerate(ts)) + "\n" * rng.randrange(3) + "x" for n, ts in imports.items()}
        if r % 3 == 0:
            texts[names[1]] = ""
        rows += [(f"r{r}", n, t) for n, t in texts.items()]
        for page in names[:2]:
            want[f"r{r}", page] = read_in_turn(page, texts, imports, 5)
    made = spark.createDataFrame(rows, "repo_id string, path string, source string")
    got = {}
    for x in reading_order(made, spark.createDataFrame(list(want), "repo_id string, path string")).collect():
        got.setdefault((x["repo_id"], x["page_path"]), []).append((x["path"], x["position"], x["offset"]))
    assert {k: sorted(v, key=lambda t: t[1]) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_interactions_of_children_and_gates_before_them(spark):  # noqa: F811
    made = files(
        spark,
        ("app/page.tsx", "import LoginForm from './components/LoginForm';"), ("app/components/LoginForm.tsx", 'export default function LoginForm() { return <Link href="/billing">Go to Billing</Link>; }'),
        ("app/billing/page.tsx", "import V from './Check';\nexport default function() { return <div onClick={() => router.push('/quiet')}/>; }"),
        ("app/billing/Check.tsx", "const s = z.object({});\n\n<form onSubmit={() => fetch('/api/x')}><a/></form>; router.push('/')"),
        ("app/quiet/page.tsx", 'const a = "/billing"; const b = "/quiet"'), ("app/unread/page.tsx", None),
    )
    nodes, edges = page_graph(made)
    got = first(edges, "src", "dst", "kind", "label")
    assert ("page:/", "page:/billing", "navigation", "Link") in got
    click = "action:app/billing/page.tsx:on-click:/quiet:2"
    assert ("page:/billing", click, "action", "onClick") in got and (click, "page:/quiet", "navigation", "Navigate") in got
    gate = "gate:app/billing/page.tsx:router-push:/:6"
    assert {("page:/billing", gate, "action", "Redirect"), (gate, "page:/", "success", "Success Path"), (gate, gate.replace("gate:", "error:"), "failure", "Failure Path")} <= set(got)
    assert ("page:/billing", "action:app/billing/page.tsx:on-submit:/api/x:6", "action", "onSubmit") in got
    assert ("page:/quiet", "page:/billing", "reference", "Reference") in got and [e for e in got if e[2] == "reference"] == [("page:/quiet", "page:/billing", "reference", "Reference")]
    ids = {r[0] for r in first(nodes, "node_id")}
    assert {x for a, b, _, _ in got for x in (a, b)} <= ids and "page:/unread" in ids
    assert ("validation", "Zod Schema", 4) in first(nodes, "type", "label", "line")
