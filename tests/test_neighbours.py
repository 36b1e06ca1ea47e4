import random
from collections import defaultdict

import pytest

from lapsewise.operators import neighbours

FEATURES = ("recency", "frequency", "monetary")


def near(a, b, eps):
    return sum((x - y) * (x - y) for x, y in zip(a, b)) <= eps * eps


def brute(points, eps, need):
    links = {i: [j for j, q in enumerate(points) if near(p, q, eps)] for i, p in enumerate(points)}
    core = {i for i, n in links.items() if len(n) >= need}
    noise = {i for i, n in links.items() if not core & set(n)}
    cluster, left = {}, set(core)
    while left:
        todo, group = [left.pop()], set()
        while todo:
            i = todo.pop()
            group.add(i)
            for j in links[i]:
                if j in left:
                    left.discard(j)
                    todo.append(j)
        for i in group:
            cluster[i] = min(group)
    return core, noise, cluster, links


@pytest.fixture(scope="module")
def points():
    rng = random.Random(5)
    dense = [tuple(rng.gauss(0, 0.3) for _ in range(3)) for _ in range(120)]
    second = [tuple(rng.gauss(4, 0.4) for _ in range(3)) for _ in range(50)]
    chain = [(6 + i * 0.2, 0.0, 0.0) for i in range(25)]
    spread = [tuple(rng.uniform(-8, 8) for _ in range(3)) for _ in range(40)]
    # A third of all rows are copies of one point; some points are copies far from everything.
    return dense + second + chain + spread + [(9.0, 9.0, 9.0)] * 4 + [(-9.0, -9.0, -9.0)] * 120


@pytest.fixture(scope="module")
def table(spark, points):
    return spark.createDataFrame(
        [(i, *map(float, p)) for i, p in enumerate(points)], "customer_id bigint, recency double, frequency double, monetary double"
    )


@pytest.mark.parametrize("eps,need", [(0.4, 10), (0.5, 4), (0.9, 6)])
def test_noise(table, points, blocks, eps, need):
    core, noise, _, _ = brute(points, eps, need)

    def found():
        rows = neighbours.dbscan_noise(table, eps, need, FEATURES).collect()
        assert len(rows) == len(points)
        return {r.customer_id for r in rows if r.core}, {r.customer_id for r in rows if r.noise}

    assert found() == (core, noise)
    if eps == 0.5:
        with blocks(3):
            assert found() == (core, noise)


@pytest.mark.parametrize("eps,need", [(0.5, 4), (0.9, 6)])
def test_clusters(table, points, eps, need):
    core, noise, cluster, links = brute(points, eps, need)
    rows = {r.customer_id: r.cluster for r in neighbours.dbscan_clusters(table, eps, need, FEATURES).collect()}
    assert {i for i, c in rows.items() if c is None} == noise
    groups = defaultdict(set)
    for i in core:
        groups[rows[i]].add(i)
    expected = defaultdict(set)
    for i, c in cluster.items():
        expected[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    for i in set(rows) - core - noise:
        assert rows[i] in {rows[j] for j in links[i] if j in core}
    summary = neighbours.cluster_summary(neighbours.dbscan_clusters(table, eps, need, FEATURES)).first()
    assert (summary.clusters, summary.noise_rows) == (len(expected), len(noise))


def test_robust_outliers(table, points):
    expected = set.intersection(*[brute(points, eps, 10)[1] for eps in (0.40, 0.45, 0.50)])
    found = {r.customer_id for r in neighbours.robust_outliers(table, (0.40, 0.45, 0.50), 10, FEATURES).collect()}
    assert found == expected


@pytest.mark.parametrize("k", [1, 5, 10])
def test_kth_neighbour(table, points, blocks, k):
    expected = [
        sorted(sum((x - y) ** 2 for x, y in zip(p, q)) for q in points)[k - 1] ** 0.5 for p in points
    ]

    def found():
        rows = {r.customer_id: r.distance for r in neighbours.kth_neighbour_distance(table, k, FEATURES).collect()}
        assert len(rows) == len(points)
        return [rows[i] for i in range(len(points))]

    assert found() == pytest.approx(expected)
    if k == 5:
        with blocks(10):
            assert found() == pytest.approx(expected)
    with pytest.raises(ValueError, match="fewer"):
        neighbours.kth_neighbour_distance(table, 1000, FEATURES)


def test_outermost_points_leave_no_cells_to_compare(spark, monkeypatch):
    rows = [(i, 0.01 * i, 0.0, 0.0) for i in range(300)] + [(1000 + i, 50.0 + 0.01 * i, 0.0, 0.0) for i in range(300)]
    df, edges, run = spark.createDataFrame(rows, "customer_id int, x double, y double, z double"), [], neighbours._components
    monkeypatch.setattr(neighbours, "_components", lambda nodes, links: edges.append(links.count()) or run(nodes, links))
    found = neighbours.dbscan_clusters(df, 0.5, 5, ("x", "y", "z")).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in found) == [300, 300]
    assert len(edges) == 2 and edges[0] > 0 and edges[1] == 0
