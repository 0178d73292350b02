"""Exact nearest neighbours and oversampling against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ebbline.operators import modeling
from ebbline.plans import neighbours
from ebbline.sources.warehouse import new_folder

POINTS = "vid string, x array<double>, tie string"


def squares(a, b):
    total = 0.0
    for s, t in zip(a, b):
        total += (s - t) * (s - t)
    return total


def cloud(kind, n, seed, dims=3):
    rnd = random.Random(seed)
    seen = set()
    while len(seen) < n:
        if kind == "even":
            p = tuple(rnd.random() for _ in range(dims))
        elif kind == "lattice":  # many ties
            p = tuple(float(rnd.randrange(9)) for _ in range(dims))
        elif kind == "clumps":  # dense clumps in thin surroundings
            centre, width = rnd.choice([((0.1,) * dims, 1e-6), ((0.9,) * dims, 1e-3), ((0.5,) * dims, 0.4)])
            p = tuple(c + rnd.uniform(-width, width) for c in centre)
        else:  # one line
            p = (rnd.random(), *([0.5] * (dims - 1)))
        seen.add(p)
    return [(f"v{i}", list(p), hashlib.md5(str(i).encode()).hexdigest()) for i, p in enumerate(sorted(seen))]


@pytest.mark.parametrize("kind,n,dims", [("even", 300, 3), ("lattice", 200, 3), ("clumps", 400, 2), ("line", 150, 3), ("even", 4, 2), ("even", 1, 2)])
def test_nearest_equals_brute_force(spark, kind, n, dims):
    points = cloud(kind, n, 3, dims)
    df = spark.createDataFrame(points, POINTS)
    searching = df.filter(F.crc32(F.col("vid").cast("binary")) % 3 > 0)
    got = {}
    for r in neighbours.nearest(searching, df, 4, new_folder(spark, "n")).collect():
        got.setdefault(r["vid"], []).append((r["place"], r["other"], r["gap"]))
    wanted = {r["vid"] for r in searching.collect()}
    for vid, x, _ in points:
        want = sorted((squares(x, y), tie, other) for other, y, tie in points if other != vid)[:4]
        if vid in wanted:
            assert sorted(got.get(vid, [])) == [(i + 1, o, g) for i, (g, _, o) in enumerate(want)]
    assert set(got) <= wanted


@pytest.mark.parametrize("kind", ["even", "clumps"])
def test_pairs_grow_with_the_points(spark, kind):
    """Ten times the points: about ten times the pairs, not a hundred times."""
    pairs = []
    for n in (300, 3000):
        df = spark.createDataFrame(cloud(kind, n, 1, 2), POINTS)
        pairs.append(neighbours.candidate_pairs(df, df, 5, new_folder(spark, "n")).count())
    assert pairs[1] < 20 * pairs[0] and pairs[1] < 60 * 3000


def made_by_hand(rows, k=5):
    """rows: (key, numbers, categories, label); the rows SMOTE adds, by comparing all pairs."""
    digest = {r[0]: hashlib.md5("|".join(map(str, r[0])).encode()).hexdigest() for r in rows}
    sizes = {y: sum(r[3] == y for r in rows) for y in (0, 1)}
    minor = min(sizes, key=lambda y: (sizes[y], y))
    few = sorted((r for r in rows if r[3] == minor), key=lambda r: digest[r[0]])
    missing, out = max(sizes.values()) - min(sizes.values()), []
    for number, r in enumerate(few, 1):
        near = sorted((q for q in few if q[0] != r[0]), key=lambda q: (squares(r[1], q[1]), digest[q[0]]))[:k]
        for copy in range(1, missing // len(few) + (number <= missing % len(few)) + 1):
            h = hashlib.md5(f"{digest[r[0]]}|{copy}".encode()).hexdigest()
            to = near[int(h[:8], 16) % len(near)] if near else r
            u = int(h[8:16], 16) / 2**32
            out.append((f"made-{copy}-{r[0][0]}", *[round(a + (b - a) * u, 9) for a, b in zip(r[1], to[1])], *to[2]))
    return sorted(out)


@pytest.mark.parametrize("minority,copies", [(1, 0), (3, 0), (40, 0), (40, 30)])
def test_smote_equals_brute_force(spark, minority, copies):
    rnd = random.Random(minority + copies)
    rows = [((f"a{i}", 0, i % 2), (rnd.random(), rnd.random(), 0.0), (rnd.choice("RC"), rnd.randrange(3)), 1) for i in range(minority)]
    rows += [((f"c{i}", 0, 0), (0.25, 0.25, 0.0), (rnd.choice("RC"), 7), 1) for i in range(copies)]
    rows += [((f"b{i}", 0, 0), (rnd.random(), 0.5, 0.0), ("R", 1), 0) for i in range(3 * len(rows) + 5)]
    df = spark.createDataFrame(
        [(*k, *x, *c, y) for k, x, c, y in rows],
        "occupant_id string, segment int, window int, f_late double, f_zero_vol double, f_anom3_vol double, cust_type_code string, municipality int, cutoff_strict int")
    names = ["f_late", "f_zero_vol", "f_anom3_vol", "cust_type_code", "municipality"]
    out = modeling.smote_oversample(df, names)
    assert out.columns == [*modeling.KEY, *names, "cutoff_strict", "synthetic"]
    found = out.collect()
    assert sum(r["cutoff_strict"] == 1 for r in found) == sum(r["cutoff_strict"] == 0 for r in found)
    made = sorted((r["occupant_id"], *(round(r[c], 9) for c in names[:3]), r["cust_type_code"], r["municipality"]) for r in found if r["synthetic"])
    assert made == made_by_hand(rows)
    keys = [tuple(r[:3]) for r in found]
    assert len(set(keys)) == len(keys)


def test_smote_passes_by_unknown_numbers(spark):
    rows = [("a", 0, 0, 0.1, 1), ("b", 0, 0, 0.3, 1), ("c", 0, 0, None, 1), ("d", 0, 0, float("nan"), 1)] + [(f"n{i}", 0, 0, 0.5, 0) for i in range(9)]
    df = spark.createDataFrame(rows, "occupant_id string, segment int, window int, f_late double, cutoff_strict int")
    made = modeling.smote_oversample(df, ["f_late"]).filter("synthetic = 1").collect()
    assert len(made) == 5 and all(0.1 <= r["f_late"] <= 0.3 for r in made)
