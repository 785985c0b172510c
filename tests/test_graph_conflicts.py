import collections
import hashlib
import itertools
import random

import numpy as np
import pytest

from estatelens.operators.conflicts import classify_pairs, conflict_classes, conflict_counts, conflicts_of, find_conflicts, responsibility_members
from estatelens.operators.graph import connected_projects, edge_classes, edges_of, graph_nodes, graph_state, hub_tables, project_edges, shared_table_edges
from estatelens.operators.pairs import shared_key_pairs
from estatelens.operators.similar import near_rows

MODES = ["read", "write", "read_write", "unknown"]


def _tables(spark, rows):
    return spark.createDataFrame(rows, "project_id long, table_name string, access_mode string")


def _catalog(spark, ids):
    return spark.createDataFrame([(i, f"g/p{i}") for i in ids], "project_id long, full_path string")


def brute_edges(rows, ids):
    by_id = {}
    for p, t, m in rows:
        by_id.setdefault(p, {})[t] = m
    out = set()
    for a, b in itertools.combinations(sorted(set(by_id) & set(ids)), 2):
        for t in by_id[a].keys() & by_id[b].keys():
            suffix = " [access: unknown]" if "unknown" in (by_id[a][t], by_id[b][t]) else ""
            out.add((a, b, t, f"shared table: {t}{suffix}"))
    return out


@pytest.mark.parametrize("block", [1, 3, 2000])
def test_edges_equal_all_pairs_with_a_hub(spark, block):
    rng = random.Random(block)
    rows = [(p, "hub", rng.choice(MODES)) for p in range(40)]
    rows += [(p, f"t{t}", rng.choice(MODES)) for p, t in {(rng.randrange(40), rng.randrange(30)) for _ in range(60)}]
    rng.shuffle(rows)
    ids = [i for i in range(40) if i % 7]
    got = shared_table_edges(_tables(spark, rows).repartition(5), _catalog(spark, ids), block)
    found = [tuple(r) for r in got.select("project_id_a", "project_id_b", "table_name", "label").collect()]
    assert len(found) == len(set(found)) and set(found) == brute_edges(rows, ids)


def test_nodes_states_and_hubs(spark):
    rows = [(7, "orders", "read"), (42, "orders", "unknown"), (9, "alone", "read"), (99, "orders", "read")]
    cat = _catalog(spark, [7, 42, 9])
    tables = _tables(spark, rows)
    assert [tuple(r) for r in graph_nodes(cat, tables).collect()] == [(7, "7 g/p7"), (42, "42 g/p42")]
    assert graph_state(cat, tables).first()["state"] == "edges"
    assert graph_state(cat, tables.filter("project_id = 9")).first()["state"] == "no_shared_dependencies"
    assert graph_state(cat.limit(0), tables).first()["state"] == "empty_catalog"
    assert [tuple(r) for r in hub_tables(tables).collect()] == [("orders", 3, 3)]
    assert {r[0] for r in connected_projects(tables).collect()} == {7, 42, 99}


def test_pairs_of_a_hot_key_spread_over_many_join_keys(spark):
    df = spark.range(200).selectExpr("'k' AS k", "id")
    pairs = shared_key_pairs(df, ["k"], "id", [], block=20)
    assert pairs.count() == 200 * 199 // 2
    assert pairs.distinct().count() == 200 * 199 // 2
    assert pairs.filter("a_id >= b_id").count() == 0


def _code(edge):
    return int(hashlib.md5(f"{edge[2]}|{edge[3]}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("seed", [3, 4])
def test_factorised_edges_say_what_all_pairs_say(spark, seed):
    rng = random.Random(seed)
    rows = [(p, "hub", rng.choice(MODES)) for p in range(60)]
    rows += [(p, f"t{t}", rng.choice(MODES)) for p, t in {(rng.randrange(60), rng.randrange(30)) for _ in range(90)}]
    ids = [i for i in range(60) if i % 7]
    tables, catalog, edges = _tables(spark, rows).repartition(5), _catalog(spark, ids), brute_edges(rows, ids)
    by_table = collections.Counter(e[2] for e in edges)
    unknown = collections.Counter(e[2] for e in edges if "unknown" in e[3])
    got = {r.table_name: (r.n_edges, r.n_unknown_edges) for r in edge_classes(tables, catalog).collect()}
    assert got == {t: (n, unknown[t]) for t, n in by_table.items()}
    per = collections.defaultdict(list)
    for e in edges:
        per[e[0]].append(e)
        per[e[1]].append(e)
    found = {r.project_id: (r.n_tables, r.n_edges, r.n_unknown_edges, r.edges_hash) for r in project_edges(tables, catalog).collect()}
    assert found == {p: (len({e[2] for e in own}), len(own), sum("unknown" in e[3] for e in own), sum(map(_code, own)) % 10**15) for p, own in per.items()}
    for asked in ([1, 2, 3, 58, 999], ids, []):
        df = spark.createDataFrame([(i,) for i in asked + asked[:1]], "project_id long")
        listed = [tuple(r) for r in edges_of(tables, df, catalog).collect()]
        assert len(listed) == len(set(listed)) and set(listed) == {e for e in edges if e[0] in asked or e[1] in asked}


def test_a_hub_makes_no_pairs(spark):
    hub = spark.range(200_000).selectExpr("id AS project_id", "'hub' AS table_name", "if(id % 10 = 0, 'unknown', 'read') AS access_mode")
    row = edge_classes(hub).first()
    assert (row.n_projects, row.n_edges, row.n_unknown_edges) == (200_000, 200_000 * 199_999 // 2, 200_000 * 199_999 // 2 - 180_000 * 179_999 // 2)
    totals = project_edges(hub).selectExpr("count(*) AS n", "sum(n_edges) AS e").first()
    assert (totals.n, totals.e) == (200_000, 200_000 * 199_999)
    asked = spark.createDataFrame([(7,)], "project_id long")
    assert edges_of(hub, asked).count() == 199_999


PALETTE = [
    "Is responsible for billing invoices and refunds",
    "is responsible for billing invoices and refunds",
    "Must not billing invoices ledger posting daily",
    "does not handle billing invoices whatever else comes",
    "billing invoices",
    "Billing invoices and refunds for customers",
    "is the owner of billing invoices with many other unrelated words inside",
    "Handles shipping labels",
    "delegates shipping labels",
    "handles",
    "unknown",
    "the of and",
    "shipping labels printing service",
    "is the source of truth for shipping labels printing",
    "does not own shipping labels printing at night",
]


def _summaries(spark, texts):
    rows = [(n, f"g/p{n}", t) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "project_id long, full_path string, purpose_summary string")


@pytest.mark.parametrize("seed", [1, 2])
def test_conflicts_equal_classified_pairs(spark, seed):
    rng = random.Random(seed)
    texts = [rng.choice(PALETTE) for _ in range(40)]
    texts += ["account ledger " + " ".join(rng.sample([f"word{i}" for i in range(12)], rng.randint(1, 9))) for _ in range(40)]
    profiles = _summaries(spark, texts)
    n = len(texts)
    everyone = spark.createDataFrame(list(itertools.combinations(range(n), 2)), "project_id_a long, project_id_b long")
    wanted = classify_pairs(everyone, profiles).filter("kind = 'conflict'").select("project_id_a", "project_id_b", "justification")
    found = find_conflicts(profiles.repartition(7), block=4).select("project_id_a", "project_id_b", "justification")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_conflict_classes_say_what_all_pairs_say(spark, seed):
    rng = random.Random(seed)
    texts = [rng.choice(PALETTE) for _ in range(40)]
    texts += ["account ledger " + " ".join(rng.sample([f"word{i}" for i in range(12)], rng.randint(1, 9))) for _ in range(30)]
    texts += [t.replace("account", "owns account") for t in texts[-8:]] + ["must not account ledger word1", "does not own account ledger"]
    profiles = _summaries(spark, texts)
    members = responsibility_members(profiles)
    pairs = [tuple(r) for r in find_conflicts(profiles).select("project_id_a", "project_id_b", "basis", "justification").collect()]
    want = collections.Counter((p, basis) for a, b, basis, _ in pairs for p in (a, b))
    got = {r.project_id: r for r in conflict_counts(members, block=4).collect()}
    assert set(got) == {r.project_id for r in members.collect()}
    assert all((r.n_overlap, r.n_contradictory) == (want[p, "overlap"], want[p, "contradictory_ownership"]) for p, r in got.items())
    assert sum(r.n_projects for r in conflict_classes(members).collect()) == len(got)
    assert all(got[r.representative].representative == r.representative for r in got.values())
    for asked in ([0, 3, 41, 999], list(range(len(texts))), []):
        df = spark.createDataFrame([(i,) for i in asked + asked[:1]], "project_id long")
        listed = sorted(map(tuple, conflicts_of(members, df, block=4).collect()))
        assert listed == sorted(p for p in pairs if p[0] in asked or p[1] in asked)


def test_copies_make_no_pairs(spark):
    half = spark.range(60_000).selectExpr("id AS project_id", "concat('g/', id) AS full_path", "if(id % 2 = 0, 'is responsible for billing invoices', 'must not billing invoices') AS purpose_summary")
    totals = conflict_counts(responsibility_members(half)).selectExpr("count(*) AS n", "sum(n_overlap + n_contradictory) AS c").first()
    assert (totals.n, totals.c) == (60_000, 60_000 * 59_999)


def test_classification_texts(spark):
    texts = ["unknown", "Is responsible for billing invoices", "must not billing invoices x y z w v u t", "other things", "unknown"]
    pairs = spark.createDataFrame([(0, 1), (0, 4), (1, 2), (1, 3)], "project_id_a long, project_id_b long")
    got = {(r["project_id_a"], r["project_id_b"]): (r["kind"], r["justification"]) for r in classify_pairs(pairs, _summaries(spark, texts)).collect()}
    assert got[0, 1] == ("indeterminate", "purpose summary is unknown for project 'g/p0'")
    assert got[0, 4] == ("indeterminate", "purpose summary is unknown for projects 'g/p0' and 'g/p4'")
    assert got[1, 2][0] == "conflict" and got[1, 2][1].startswith("purpose summaries assert contradictory ownership of 'billing invoice': \"")
    assert got[1, 3] == (
        "no_conflict",
        "purpose summaries describe different primary responsibilities ('billing invoice' vs 'other thing'): "
        '"Is responsible for billing invoices" vs "other things"',
    )


@pytest.mark.parametrize("seed", [5, 6])
def test_near_rows_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 400, rng.integers(1, 300))) for _ in range(12)]
    tokens = [np.unique(np.concatenate([rng.permutation(b)[: max(1, int(len(b) * rng.uniform(0.5, 1)))], rng.integers(0, 2**62, 3)])) for b in base for _ in range(6)]
    wanted = rng.random(len(tokens)) < 0.7

    def near(x, y):
        both = len(np.intersect1d(tokens[x], tokens[y]))
        return (wanted[x] or wanted[y]) and both / (len(tokens[x]) + len(tokens[y]) - both) >= 0.6

    ids = np.arange(len(tokens))
    told = [tuple(sorted((int(x), int(y)))) for x, ys in near_rows(tokens, ids, None, wanted, 0.6) for y in ys]
    assert len(told) == len(set(told)) and set(told) == {p for p in itertools.combinations(range(len(tokens)), 2) if near(*p)} != set()
    two = {(int(x), int(y)) for x, ys in near_rows(tokens, ids[::2], ids[1::2], wanted, 0.6) for y in ys}
    assert two == {(x, y) for x in range(0, len(tokens), 2) for y in range(1, len(tokens), 2) if near(x, y)}


def test_a_popular_key_makes_no_candidate_rows(spark):
    """Rows sent grow with the summaries times the blocks of their key, not with its pairs."""
    sums = spark.range(3000).selectExpr("id AS project_id", "'g' AS full_path", "concat('ledger account common words of all a', id, ' b', id, ' c', id) AS purpose_summary")
    counts = conflict_counts(responsibility_members(sums.repartition(3)), block=1500)
    assert counts.selectExpr("sum(n_overlap + n_contradictory)").first()[0] == 0
    counts.collect()
    sent, todo = [], [counts._jdf.queryExecution().executedPlan().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            sent.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert sent and max(sent) <= 3000 * 2
