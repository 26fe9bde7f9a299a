"""Grouping by density against NumPy: the spanning tree, merge sizes, labels."""

import numpy as np

from checks.queries import QUERIES
from copyloom.operators import density as de
from copyloom.session import cut


def brute(points, m, min_samples=None, single=False):
    """Labels, tree edges and merge sizes from all pairs, one merge after the other, with sets."""
    n, k = len(points), min_samples or m
    apart = np.floor(np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)) / 1e-9) * 1e-9
    core = np.array([np.sort(np.delete(apart[i], i))[min(k, n - 1) - 1] for i in range(n)])
    pairs = sorted((max(apart[i, j], core[i], core[j]), i, j) for i in range(n) for j in range(i + 1, n))
    of = [frozenset([i]) for i in range(n)]
    tree, inside = [], {}  # a merge by its members: weight and sides
    for w, i, j in pairs:
        if of[i] is not of[j]:
            tree.append((i, j, w, len(of[i]), len(of[j])))
            whole = of[i] | of[j]
            inside[whole] = (w, of[i], of[j])
            for x in whole:
                of[x] = whole

    def cluster(members, birth):
        """(stability, best choice of groups) of a group that begins with these members."""
        own, rest = 0.0, members
        while len(rest) > 1 and len(rest) >= m:
            w, x, y = inside[rest]
            lam = 1 / max(w, 1e-9)
            if len(x) >= m and len(y) >= m:
                parts = [cluster(x, lam), cluster(y, lam)]
                own += len(rest) * (lam - birth)
                best, groups = sum(p[0] for p in parts), [g for p in parts for g in p[1]]
                return (own, [members]) if own >= best and (single or birth) else (best, groups)
            gone = sum(len(s) for s in (x, y) if len(s) < m)
            own += gone * (lam - birth)
            rest = x if len(x) >= m else y
        return (own, [members]) if single or birth else (0.0, [])

    groups = cluster(of[0], 0.0)[1] if n >= m else []
    labels = np.full(n, -1)
    for label, group in enumerate(sorted(groups, key=lambda g: (-len(g), min(g)))):
        labels[list(group)] = label
    return labels, tree


def long(spark, points):
    rows = [(f"p{i:04d}", d, float(v)) for i, p in enumerate(points) for d, v in enumerate(p)]
    return cut(spark.createDataFrame(rows, "sample_name string, dim int, v double"))


def planted(rng, n):
    """Two dense groups side by side inside a wide one, another wide one far off, stragglers, repeated points."""
    parts = [rng.normal([0, 0], 0.1, (n, 2)), rng.normal([1.2, 0], 0.1, (n, 2)), rng.normal([20, 0], 3, (2 * n, 2)), rng.uniform(-40, 40, (n // 4, 2))]
    return np.vstack([*parts, np.zeros((3, 2))])


def test_two_densities_and_the_tree(spark):
    points = planted(np.random.default_rng(1), 20)
    labels, tree = brute(points, 8)
    assert len(set(labels) - {-1}) == 3 and (labels == -1).any()
    p = long(spark, points)
    cores = cut(de.core_distances(de.sample_vectors(p), 8, block=32))
    edges = de.spanning_tree(cores, block=32)
    expected = sorted((f"p{min(i, j):04d}", f"p{max(i, j):04d}", w) for i, j, w, _, _ in tree)
    assert sorted((e.a, e.b, e.weight) for e in edges.collect()) == expected
    for chunk in (4096, 30):
        found = de.merges(edges, cores, chunk).orderBy("rank").collect()
        assert [r["rank"] for r in found] == list(range(len(tree)))
        assert [sorted((r.size_a, r.size_b)) for r in found] == [sorted(t[3:]) for t in tree]
    found = de.density_groups(p, 8).orderBy("sample_name").collect()
    assert [r.label for r in found] == labels.tolist()


def test_five_hundred_samples(spark):
    rng = np.random.default_rng(2)
    points = np.vstack([planted(rng, 100), rng.normal([-20, 15], 1, (64, 2))])[:500]
    labels, _ = brute(points, 12)
    assert len(set(labels)) > 3
    found = de.density_groups(long(spark, points), 12, block=200).orderBy("sample_name").collect()
    assert [r.label for r in found] == labels.tolist()


def test_one_group_few_samples_and_none(spark):
    points = np.random.default_rng(3).normal(size=(15, 3))
    labels, _ = brute(points, 12, 3, single=True)
    found = de.density_groups(long(spark, points), 12, 3, single=True).orderBy("sample_name").collect()
    assert [r.label for r in found] == labels.tolist()
    assert [r.label for r in de.density_groups(long(spark, points[:3]), 12).collect()] == [-1] * 3
    assert de.density_groups(long(spark, points[:0]), 2).count() == 0


def test_registered_groups_are_those_of_the_components(spark, middle):
    from checks.queries import MIN_CLUSTER, component_points

    wide = component_points(spark, middle).toPandas().pivot(index="sample_name", columns="dim", values="v")
    labels, _ = brute(wide.to_numpy(), MIN_CLUSTER)
    found = QUERIES["density_groups"](spark, middle).orderBy("sample_name").collect()
    assert [r.label for r in found] == labels.tolist()
    kits = {(r.label, r.sample_name < "S12") for r in found if r.label >= 0}
    assert len(kits) == len({label for label, _ in kits}) == 2
