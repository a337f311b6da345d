import heapq
import math
import random

import pytest

from terrane.operators import clusters, graphs, network, ranks, sweeps


def test_a_long_path_settles_in_few_rounds(spark, monkeypatch):
    """The combiner is held to two edges, so that the rounds do the work."""
    monkeypatch.setattr(graphs, "TOGETHER", 2)
    ids = list(range(2000))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([*zip(ids, ids[1:]), (5000, 5000), (7000, 6000), (None, 3)], "a long, b long").coalesce(1)
    monkeypatch.setattr(graphs, "_packed", lambda edges: edges)
    got = dict(map(tuple, graphs.components(df, most_rounds=15).collect()))
    assert len(got) == 2003 and {got[i] for i in range(2000)} == {0} and got[5000] == 5000 and got[7000] == got[6000] == 6000
    assert graphs.components(df.limit(0)).count() == 0


def test_ranks_are_places(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1009 as k", "id").repartition(7)
    got = ranks.ranked(df, "k", "id").collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (r["k"], r["id"]))] == list(range(1000))
    assert sorted(r["k"] for r in ranks.first(df, 10, "k", "id").collect()) == sorted(r["k"] for r in got)[:10]
    assert ranks.first(df.limit(0), 3, "k").count() == 0


def _layer(spark, rows):
    return spark.createDataFrame([(f, [{"x": float(x), "y": float(y)} for x, y in g]) for f, g in rows], "fid long, geom array<struct<x:double,y:double>>")


def _plain_sums(near, weighted):
    """Betweenness and load by Brandes' rule, one source after the other; lengths in whole units."""
    between, load = dict.fromkeys(near, 0.0), dict.fromkeys(near, 0.0)
    for s in near:
        far, heap, order = {s: 0}, [(0, s)], []
        while heap:
            d, v = heapq.heappop(heap)
            if d == far[v] and v not in order:
                order.append(v)
                for u, w in near[v].items():
                    new = d + (w if weighted else 1)
                    if new < far.get(u, new + 1):
                        far[u] = new
                        heapq.heappush(heap, (new, u))
        before = {v: [u for u, w in near[v].items() if far[u] + (w if weighted else 1) == far[v]] for v in order}
        count = {}
        for v in order:
            count[v] = 1 if v == s else sum(count[u] for u in before[v])
        part, carried = dict.fromkeys(order, 0.0), dict.fromkeys(order, 1.0)
        for v in reversed(order):
            for u in before[v]:
                part[u] += count[u] / count[v] * (1 + part[v])
                carried[u] += carried[v] / len(before[v])
            if v != s:
                between[v] += part[v]
                load[v] += carried[v] - 1
    return between, load


def _near(rows):
    near = {}
    for _, line in rows:
        for a, b in zip(line, line[1:]):
            w = round(math.dist(a, b) / sweeps.UNIT)
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    return near


@pytest.mark.parametrize("strip, block, wave, weighted", [(20_000, 32, 4096, False), (8, 4, 3, True)])
def test_centrality_equals_one_source_after_the_other(spark, monkeypatch, strip, block, wave, weighted):
    """One strip and one wave, or many of both: a path crosses strips to and fro."""
    for name, value in (("STRIP", strip), ("BLOCK", block), ("WAVE", wave)):
        monkeypatch.setattr(sweeps, name, value)
    rows = [(i * 10 + j, [(i, j), (i + 1, j)]) for i in range(3) for j in range(3)] + [(100 + i * 10 + j, [(i, j), (i, j + 1)]) for i in range(3) for j in range(2)]
    rows += [(500, [(50, 50), (51, 50.5), (53, 50)]), (600, [(0, 2), (9, 9), (-4, 9), (9, 12), (3, 2)])]
    near = _near(rows)
    between, load = _plain_sums(near, weighted)
    pairs = lambda v: {True: 2 * 1, False: max((len(near) - 4) * (len(near) - 5), 1)}[v[0] >= 50]
    got = network.centrality(*network.build(_layer(spark, rows)), weighted).collect()
    assert len(got) == len(near)
    for r in got:
        v = (r["x"], r["y"])
        assert math.isclose(r["betweenness"], between[v] / pairs(v), abs_tol=1e-9) and math.isclose(r["load"], load[v] / pairs(v), abs_tol=1e-9), v


@pytest.mark.parametrize("strip", [20_000, 6])
def test_sampled_paths_are_the_shortest(spark, monkeypatch, strip):
    monkeypatch.setattr(sweeps, "STRIP", strip)
    rng = random.Random(3)
    places = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    rows = [(i, [rng.choice(places), rng.choice(places)]) for i in range(45)] + [(90, [(100, 0), (101, 0), (101, 1)]), (91, [(200, 0), (201, 0)])]
    rows = [(f, g) for f, g in rows if g[0] != g[1]]
    near = _near(rows)
    nodes, edges = network.build(_layer(spark, rows))
    part = network.node_components(nodes, edges).selectExpr("node.x", "node.y", "xxhash64(node) as id", "xxhash64(component) as c").collect()
    name, expected = {r["id"]: (r["x"], r["y"]) for r in part}, {}
    for c in sorted({r["c"] for r in part})[:3]:
        ids = [r["id"] for r in part if r["c"] == c]
        s, t = name[min(ids)], name[max(ids)]
        best, heap = {s: (0, 0)}, [(0, 0, s)]
        while heap:
            d, n, v = heapq.heappop(heap)
            for u, w in near[v].items():
                if (d + w, n + 1) < best.get(u, (1 << 62, 0)):
                    best[u] = (d + w, n + 1)
                    heapq.heappush(heap, (*best[u], u))
        expected[c] = best[t]
    got = {r["component"]: (round(r["length"] / sweeps.UNIT), r["hops"]) for r in network.sample_paths(nodes, edges, 3).collect()}
    assert got == expected


def test_networks_without_edges(spark):
    nodes, edges = network.build(_layer(spark, [(1, [(0, 0)])]))
    assert [tuple(r) for r in network.centrality(nodes, edges).collect()] == [(0.0, 0.0, 0.0, 0.0)]
    assert network.sample_paths(nodes, edges).count() == 0
    nodes, edges = network.build(_layer(spark, []))
    assert network.centrality(nodes, edges).count() == 0 and network.sample_paths(nodes, edges).count() == 0


def test_chains_keep_their_geometry(spark):
    nodes, edges = network.build(_layer(spark, [(3, [(0, 0), (1, 0), (2, 1)]), (1, [(2, 1), (3, 1)]), (2, [(3, 1), (3, 5)]), (4, [(3, 1), (9, 1)])]))
    got = {r["fid"]: [(p["x"], p["y"]) for p in r["geom"]] for r in network.chain_lines(nodes, edges).collect()}
    assert got == {1: [(0.0, 0.0), (1.0, 0.0), (2.0, 1.0), (3.0, 1.0)], 2: [(3.0, 1.0), (3.0, 5.0)], 4: [(3.0, 1.0), (9.0, 1.0)]}


def test_silhouette_is_that_of_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(0, 180), rng.randrange(3)) for i in range(120)] + [(900, 10.0, 3), (901, None, 1), (902, 10.0, 0)]
    points = [(math.cos(math.radians(2 * a)), math.sin(math.radians(2 * a)), c) for _, a, c in rows if a is not None]
    total = 0.0
    for i, (x, y, c) in enumerate(points):
        far: dict[int, list[float]] = {}
        for j, (u, v, o) in enumerate(points):
            if j != i:
                far.setdefault(o, []).append(math.hypot(x - u, y - v))
        if c in far:
            a, b = sum(far[c]) / len(far[c]), min(sum(d) / len(d) for o, d in far.items() if o != c)
            total += (b - a) / max(a, b)
    got = clusters.silhouette(spark.createDataFrame(rows, "fid long, az double, cluster int"), "az")
    assert abs(got - total / len(points)) < 1e-9
