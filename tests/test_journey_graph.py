"""The journey graph of small repositories, all of them in one table."""

import pytest
from test_reference import spark  # noqa: F401

from reposcope.operators import journey_graph as jg
from reposcope.operators.journey_graph import journey_graph

LOGIN = ("app/login/page.tsx", "export default function Login() { return signIn() }")
LOGOUT = ("app/logout/page.tsx", "export default function Logout() { return signOut() }")
USERS = ("api/users/route.ts", "export async function GET(req) { return Response.json({}) }")
PRISMA = ("lib/prisma.ts", "import { prisma } from '@prisma/client'")
KINDS = [
    (LOGIN, "auth", "diamond"), (LOGOUT, "logout", "pill"), (("lib/validate.ts", "const schema = z.object({ email: z.string() })"), "validation", "diamond"), (USERS, "action", "rectangle"),
    (PRISMA, "database", "cylinder"), (("app/dashboard/page.tsx", "router.push('/settings'); router.push('/profile')"), "decision", "diamond"),
]
STORES = [
    ("app/register/page.tsx", "signIn(); register()", "api/auth/route.ts", "export async function POST() { return prisma.user.create() }", "auth profile created", "store profile"),
    ("app/projects/new/page.tsx", "createProject()", "api/projects/route.ts", "export async function POST() { return prisma.project.create() }", "project stored", "save project"),
    ("app/posts/new/page.tsx", "createPost(); publish()", "api/posts/route.ts", "export async function POST() { return prisma.post.create() }", "post stored", "save post"),
    ("app/checkout/page.tsx", "placeOrder(); submit()", "api/orders/route.ts", "export async function POST() { return prisma.order.create() }", "order stored", "save order"),
    ("app/profile/edit/page.tsx", "updateProfile()", "api/profile/route.ts", "export async function PUT() { return prisma.profile.update() }", "profile updated", "update record"),
]
CASES = {
    "empty": [],
    "checked": [("app/login/page.tsx", "const s = z.object({email: z.string()}); signIn()"), LOGOUT],
    "full": [("app/page.tsx", "export default function Home() {}"), ("app/login/page.tsx", "signIn(); z.object({email: z.string()})"), ("api/users/route.ts", "export async function GET() { return prisma.user.findMany() }"), PRISMA, LOGOUT],
    "plain": [LOGIN, USERS, PRISMA, LOGOUT],
    "bus": [
        ("api/order/route.ts", "import { Order } from '@/models/order'\nexport async function POST() {}"), ("lib/order.ts", "export const schema = {}"), ("lib/user.ts", "export const model = {}"),
        ("src/jobs/a.ts", "setInterval(run)"), ("src/workers/b.ts", "setInterval(run)"), ("package.json", '{"dependencies": {"bullmq": "1", "stripe": "2", "left-pad": "1"}}'),
    ],
    "bridges": [("api/a/route.ts", "export async function GET() {}"), ("api/b/route.ts", "export async function GET() {}"), ("lib/x.ts", "mongoose"), LOGOUT],
    "branches": [("app/a/page.tsx", "router.push('/c'); router.push('/d')"), ("app/b/page.tsx", ""), ("app/c/page.tsx", ""), ("app/d/page.tsx", ""), ("app/c/page.tsx", ""), ("none.ts", None)],
    **{f"kind {k}": [k_file] for k, (k_file, _, _) in enumerate(KINDS)},
    **{f"store {k}": [(c[0], c[1]), (c[2], c[3])] for k, c in enumerate(STORES)},
}


@pytest.fixture(scope="module")
def journeys(spark):  # noqa: F811
    """Nodes by id and edges of each case."""
    rows = [(case, p, s) for case, found in CASES.items() for p, s in found]
    nodes, edges = journey_graph(spark.createDataFrame(rows, "repo_id string, path string, source string"), spark.createDataFrame([(c,) for c in CASES], "repo_id string"))
    every, links = nodes.collect(), edges.collect()
    assert len({(r["repo_id"], r["node_id"]) for r in every}) == len(every)
    return {c: ({r["node_id"]: r for r in every if r["repo_id"] == c}, {(r["src"], r["dst"], r["kind"]) for r in links if r["repo_id"] == c}) for c in CASES}


@pytest.mark.parametrize("case", CASES)
def test_every_node_is_joined(journeys, case):
    found, led = journeys[case]
    assert all(a in found and b in found for a, b, _ in led)
    assert {b for _, b, _ in led} >= {n for n, r in found.items() if r["type"] != "start"}
    assert {a for a, _, _ in led} >= {n for n, r in found.items() if r["type"] != "end"}


def kinds(found):
    return {r["type"] for r in found.values()}


def of(found, kind):
    return [n for n, r in found.items() if r["type"] == kind]


def test_empty_repositories_have_a_loop(journeys):
    found, led = journeys["empty"]
    assert set(found) == {"start::Start", "page::Landing Page", "end::Loop"}
    assert led >= {("start::Start", "page::Landing Page", "open app"), ("page::Landing Page", "end::Loop", "complete"), ("end::Loop", "page::Landing Page", "restart")}
    assert [(r["col"], r["row"]) for r in (found["start::Start"], found["page::Landing Page"], found["end::Loop"])] == [(0, 0), (1, 0), (8, 0)]


@pytest.mark.parametrize("k", range(len(KINDS)))
def test_kinds_of_nodes(journeys, k):
    found, _ = journeys[f"kind {k}"]
    assert {found[n]["shape"] for n in of(found, KINDS[k][1])} == {KINDS[k][2]}


def test_sign_in_and_its_check(journeys):
    found, led = journeys["checked"]
    auth, check, out = of(found, "auth")[0], of(found, "validation")[0], of(found, "logout")[0]
    assert auth == "auth:Auth: /login@app/login/page.tsx"
    assert led >= {("page::Landing Page", auth, "needs login"), (auth, check, "check"), (check, auth, "fail → retry"), (out, "end::Loop", "complete"), ("end::Loop", "page::Landing Page", "restart")}


def test_full_journey(journeys):
    found, led = journeys["full"]
    assert kinds(found) >= {"start", "page", "auth", "validation", "action", "database", "logout", "end"} and len(led) >= 8


@pytest.mark.parametrize("k", range(len(STORES)))
def test_stores(journeys, k):
    found, led = journeys[f"store {k}"]
    label, edge = STORES[k][4:]
    assert any(b == f"database:{label}" and kind == edge for _, b, kind in led) and found[f"database:{label}"]["type"] == "database"


def test_services_share_a_bus_and_models_meet_tables(journeys):
    found, led = journeys["bus"]
    action = "action:CREATE: route@api/order/route.ts"
    assert (action, "database:DB: order", "CREATE → order") in led and not any(a == action and b == "database:DB: user" and k != "flow" for a, b, k in led)
    services = {"service:Service: a", "service:Service: b", "service:Service: BullMQ"}
    assert set(of(found, "service")) == services | {"service::Service Bus"} and of(found, "external_service") == ["external_service:External: Stripe"]
    bus = {(a, k) for a, b, k in led if b == "service::Service Bus"}
    assert {(s, "publish") for s in services} <= bus and ("service::Service Bus", "database:DB: order", "process") in led or of(found, "bridge")
    assert sorted(found[s]["row"] for s in [*services, "service::Service Bus", action, "external_service:External: Stripe"]) == list(range(6))


def test_bridges_between_sections(journeys):
    found, led = journeys["bridges"]
    names = {found[n]["label"] for n in of(found, "bridge")}
    assert "Core API → Data Layer" in names
    bridge = "bridge:core:data"
    assert ("action:API: route@api/a/route.ts", bridge, "next section") in led or ("action:READ: route@api/a/route.ts", bridge, "next section") in led
    assert (bridge, "database:DB: x", "next section") in led


def test_decisions_branch_to_pages(journeys):
    found, led = journeys["branches"]
    choice = "decision:Choose: /a@app/a/page.tsx"
    assert led >= {(choice, "page:/c", "yes"), (choice, "page:/d", "yes"), (choice, "page:/a", "navigate"), ("page:/a", "page:/b", "navigate"), ("page::Landing Page", "page:/a", "browse"), ("page:/a", choice, "browse")}
    assert not any(b in ("page:/c", "page:/d") and k == "navigate" for _, b, k in led)


def test_nodes_need_not_meet_every_action_with_every_database(spark):  # noqa: F811
    made = [(f"app/api/a{k}/route.ts", "export async function POST(r) { supabase.from('order').insert(r) }") for k in range(30)]
    made += [(f"lib/order{k}.ts", "const schema = 1") for k in range(30)]
    nodes, edges = jg.journey_graph(spark.createDataFrame([("r", p, s) for p, s in made], "repo_id string, path string, source string"))
    # the actions share the stores of orders and of posts, the first of which their model names as well
    assert edges.filter("kind = 'CREATE → order'").count() == 30 * 31 and nodes.filter("type = 'database'").count() == 32
    _, actions, found = jg.woven(jg.journey_nodes(spark.createDataFrame([("r", p, s) for p, s in made], "repo_id string, path string, source string")))
    assert (actions.count(), found.count()) == (30, 31)
