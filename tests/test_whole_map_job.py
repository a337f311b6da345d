"""Merges of lines and polygons equal a plain walk one after the other, in blocks of any size."""

import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import lines, polygons

RING = "array<struct<x: double, y: double>>"


def test_merge_joins_a_long_chain_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "PAIRS_TOGETHER", 40)
    rows = [(i, [{"x": i * 10.0, "y": 0.0}, {"x": i * 10.0 + 10.0, "y": 0.0}]) for i in range(60)]
    df = spark.createDataFrame(rows, f"fid long, geom {RING}")
    got = lines.merge_lines(df, 1.0, 30.0, 150.0).collect()
    assert [sorted(r["members"]) for r in got] == [list(range(60))] and len(got[0]["geom"]) == 61
    with pytest.raises(RuntimeError):
        lines.merge_lines(df, 1.0, 30.0, 150.0, most_passes=1)


def greedy(pairs):
    used, out = set(), set()
    near = {}
    for a, ea, b, eb, s in pairs:
        near.setdefault(a, []).append((s, b, ea, eb))
        near.setdefault(b, []).append((s, a, eb, ea))
    for own in sorted(near, reverse=True):
        for _, other, own_end, other_end in sorted(near[own]) if own not in used else ():
            if other not in used:
                used |= {own, other}
                out.add((own, own_end, other, other_end))
                break
    return out


@pytest.mark.parametrize("seed, together", [(1, 12), (2, 60), (3, 10_000)])
def test_a_pass_equals_the_walk(spark, monkeypatch, seed, together):
    monkeypatch.setattr(lines, "PAIRS_TOGETHER", together)
    rng = random.Random(seed)
    pairs = {(a, b): (a, rng.choice(["start", "end"]), b, rng.choice(["start", "end"]), float(rng.randrange(4))) for a, b in (sorted(rng.sample(range(80), 2)) for _ in range(150))}
    pairs |= {(k, k + 1): (k, "end", k + 1, "start", 0.0) for k in range(100, 140)}
    df = spark.createDataFrame(list(pairs.values()), "fid1 long, end1 string, fid2 long, end2 string, score double")
    assert {tuple(r) for r in lines._matches(df).collect()} == greedy(pairs.values())


def walk(chosen):
    gone, out, of = set(), set(), {}
    for fid, target, reason in sorted(chosen):
        of.setdefault(target, []).append((fid, reason))
    for target, small in of.items():
        if target not in gone:
            out |= {(f, target, r) for f, r in small if f not in gone}
            gone |= {f for f, _ in small}
    return out


def test_settled_merges_equal_the_walk(spark):
    schema = "fid long, target long, reason string"
    rng = random.Random(5)
    cases = [[(i, 0, "x") for i in range(1, 31)], [(i, i - 1, "x") for i in range(1, 41)], [(i, i + 1, "x") for i in range(40)], [(i, (i + 1) % 30, "x") for i in range(30)]]
    cases += [[(i, rng.choice([j for j in range(50) if j != i]), rng.choice("ab")) for i in rng.sample(range(50), 40)] for _ in range(4)]
    for chosen in cases:
        assert {tuple(r) for r in polygons.settle(spark.createDataFrame(chosen, schema)).collect()} == walk(chosen)


def box(x, y, w=10.0, h=10.0):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def one_by_one(cells, target):
    """fid -> members, cells being fid -> (ring, strat1) of boxes on a noded grid: a plain loop over the smallest."""
    area = {f: abs((r[2][0] - r[0][0]) * (r[2][1] - r[0][1])) for f, (r, _) in cells.items()}
    lines_of = {f: {tuple(sorted(e)) for e in zip(r, r[1:])} for f, (r, _) in cells.items()}
    length = lambda a, b: sum(abs(p[0] - q[0]) + abs(p[1] - q[1]) for p, q in lines_of[a] & lines_of[b])
    shared = {f: {g: length(f, g) for g in cells if g != f and length(f, g)} for f in cells}
    members = {f: [f] for f in cells}
    span = {f: [r[0][0], r[0][1], r[2][0], r[2][1]] for f, (r, _) in cells.items()}
    middle = {f: [area[f] * (r[0][0] + r[2][0]) / 2, area[f] * (r[0][1] + r[2][1]) / 2] for f, (r, _) in cells.items()}
    while len(area) > target:
        s = min(area, key=lambda f: (area[f], f))
        if shared[s]:
            best = min(shared[s], key=lambda g: (cells[g][1] != cells[s][1], -round(shared[s][g], 6), g))
        else:
            meets = [g for g in area if g != s and span[g][0] <= span[s][2] and span[g][2] >= span[s][0] and span[g][1] <= span[s][3] and span[g][3] >= span[s][1]]
            far = lambda g: round(sum((middle[g][i] / area[g] - middle[s][i] / area[s]) ** 2 for i in (0, 1)) ** 0.5, 6)  # noqa: B023, E731
            best = min(meets, key=lambda g: (far(g), g)) if meets else None
        if best is not None:
            members[best] += members[s]
            area[best] += area[s]
            middle[best] = [a + b for a, b in zip(middle[best], middle[s])]
            span[best] = [min(span[best][0], span[s][0]), min(span[best][1], span[s][1]), max(span[best][2], span[s][2]), max(span[best][3], span[s][3])]
            for g, n in shared[s].items():
                if g != best:
                    shared[best][g] = shared[g][best] = shared[best].get(g, 0) + n
        for g in shared.pop(s):
            del shared[g][s]
        for held in (area, members, span, middle):
            del held[s]
    return {f: sorted(m) for f, m in members.items()}


def test_merging_to_a_count_equals_one_by_one(spark):
    rng = random.Random(11)
    xs, ys = [sorted(rng.sample(range(200), 9)) for _ in range(2)]
    cells = {i * 8 + j: (box(xs[i], ys[j], xs[i + 1] - xs[i], ys[j + 1] - ys[j]), rng.choice("abc")) for i in range(8) for j in range(8)}
    cells |= {100: (box(xs[2] + 0.25, ys[2] + 0.25, 0.5, 0.5), "a"), 101: (box(xs[5] + 0.25, ys[1] + 0.125, 0.25, 0.25), "b"), 102: (box(900, 900, 0.5, 0.25), "c"), 103: (box(950, 900, 4, 4), "c")}
    df = spark.createDataFrame([(f, [{"x": float(x), "y": float(y)} for x, y in r], u) for f, (r, u) in cells.items()], f"fid long, ring {RING}, strat1 string")
    got = {r["fid"]: r["inherit"] for r in polygons.merge_to_count(df, 40, ["strat1"]).collect()}
    assert got == one_by_one(cells, 40) and len(got) == 40 and not any(102 in m for m in got.values())


def test_merge_to_count_takes_the_smallest_first(spark):
    p = spark.createDataFrame([(f, [{"x": float(x), "y": float(y)} for x, y in r], "a") for f, r in ((0, box(0, 0)), (1, box(10, 0, 9)), (2, box(100, 0, 1)))], f"fid long, ring {RING}, strat1 string")
    assert sorted((r["fid"], r["inherit"]) for r in polygons.merge_to_count(p, 2, ["strat1"]).collect()) == [(0, [0]), (1, [1])]  # nothing is near the smallest, so it goes


def test_orphans_are_counted(spark):
    p = spark.createDataFrame([(f, [{"x": float(x), "y": float(y)} for x, y in r], "a") for f, r in ((0, box(0, 0)), (1, box(10, 0, 1)), (2, box(100, 0, 1)))], f"fid long, ring {RING}, strat1 string")
    got, reasons = polygons.clean_small(p, 50.0, ["strat1"])
    assert {r["fid"]: r["inherit"] for r in got.collect()} == {0: [0, 1], 2: [2]} and {r["reason"]: r["n"] for r in reasons.collect()} == {"same_strat1": 1, "orphan": 1}
