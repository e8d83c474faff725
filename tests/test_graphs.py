"""Components and walks on graphs of any shape, against plain Python."""

import random
import time

import pytest

from tidewell.operators.graphs import LOCAL_EDGES, _tarjan, on_cycles, strong_components, walk_up

EDGES = "child long, parent long"


def components_of(nodes, edges):
    """Components by reachability from every node."""
    out = {n: [p for c, p in edges if c == n] for n in nodes}

    def reach(n):
        seen, open_ = {n}, [n]
        while open_:
            for p in out.get(open_.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    open_.append(p)
        return seen

    far = {n: reach(n) for n in nodes}
    return {n: min(m for m in far[n] if n in far[m]) for n in nodes}


def found(spark, nodes, edges, local=LOCAL_EDGES):
    rows = strong_components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, EDGES), local).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("length,local", [(2, LOCAL_EDGES), (1000, LOCAL_EDGES), (200, 0)])
def test_a_ring_of_any_length_is_one_component(spark, length, local):
    edges = [(i, (i + 1) % length) for i in range(length)] + [(length, 0), (length - 1, length + 1), (length + 1, length + 2)]
    got = found(spark, [length + 5], edges, local)
    assert got == {**dict.fromkeys(range(length), 0), **{n: n for n in (length, length + 1, length + 2, length + 5)}}


def test_on_cycles_of_a_long_ring_and_a_loop(spark):
    edges = [(i, (i + 1) % 200) for i in range(200)] + [(300, 300), (300, 0), (5, 400)]
    assert sorted(r.node for r in on_cycles(spark.createDataFrame(edges, EDGES)).collect()) == [*range(200), 300]


@pytest.mark.parametrize("seed,local", [(1, LOCAL_EDGES), (3, LOCAL_EDGES), (2, 40)])
def test_random_graphs(spark, seed, local):
    rng = random.Random(seed)
    nodes = list(range(60))
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(60 + 20 * seed)]
    edges += [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(105, 110), (110, 111), (111, 112), (112, 110), (112, 120), (120, 121), (121, 130), (130, 131), (131, 130)]
    every = sorted({*nodes, *(n for e in edges for n in e)})
    assert found(spark, nodes, edges, local) == components_of(every, edges)


def test_a_walk_takes_time_by_edges():
    began = time.perf_counter()
    rings = [(3 * i + j, 3 * i + (j + 1) % 3) for i in range(80_000) for j in range(3)] + [(3 * i, 3 * i + 3) for i in range(79_999)]
    least = _tarjan(rings)
    assert all(least[n] == n - n % 3 for n in range(240_000))
    assert time.perf_counter() - began < 10  # each component closed once copied all that was open


def test_no_edges(spark):
    assert found(spark, [1, 2], []) == {1: 1, 2: 2}


def test_walks_to_the_root_of_a_long_chain(spark):
    parents = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 130)], "node long, parent long")
    got = sorted(map(tuple, walk_up(parents).collect()))
    assert got == sorted((n, a, n - a) for n in range(1, 130) for a in range(1, n + 1))


def test_a_parent_that_is_no_node_ends_the_walk(spark):
    parents = spark.createDataFrame([(1, 7), (2, 1), (3, None)], "node long, parent long")
    assert sorted(map(tuple, walk_up(parents).collect())) == [(1, 1, 0), (1, 7, 1), (2, 1, 1), (2, 2, 0), (2, 7, 2), (3, 3, 0)]


def test_rings_in_a_chain_need_no_label_rounds(spark, monkeypatch):
    """More edges in one part than a walk may hold; the rings' nodes lie together by name, or only by where edges lead."""
    from tidewell.operators import graphs

    monkeypatch.setattr(graphs, "_one_turn", lambda *a: pytest.fail("label rounds"))
    for name in (lambda n: n, lambda n: n * 7919 % 1009):
        edges = [(name(20 * r + i), name(20 * r + (i + 1) % 20)) for r in range(45) for i in range(20)] + [(name(20 * r + 5), name(20 * r + 25)) for r in range(44)]
        want = {name(20 * r + i): min(name(20 * r + j) for j in range(20)) for r in range(45) for i in range(20)}
        assert found(spark, [5000], edges, 300) == {**want, 5000: 5000}
