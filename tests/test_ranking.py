import random

import pytest

from linkloom.operators import compare, graph, incremental
from linkloom.operators.pagerank import PRESETS, normalized, pagerank, run_preset, top_k
from linkloom.sources import readers, writers
from linkloom.streaming.refresh import RankFollower


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def plain(pairs, n, k, spread=True, start=None, active=None, d=0.85):
    r = list(start or [1 / n] * n)
    deg = [0] * n
    for s, _ in pairs:
        deg[s] += 1
    for _ in range(k):
        mass = sum(r[i] for i in range(n) if not deg[i]) if spread else 0
        new = [(1 - d) / n + d * mass / n] * n
        for s, t in pairs:
            new[t] += d * r[s] / deg[s]
        r = [new[i] if active is None or i in active else r[i] for i in range(n)]
    return r


def values(df):
    return [r["rank"] for r in df.orderBy("node_id").collect()]


def random_graph(n=30, m=90, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(n - 5), rng.randrange(n)) for _ in range(m)] + [(0, n - 1)]


def test_three_nodes_reach_the_known_ranks(spark, tmp_path):
    got = run_preset("sequential", edges_of(spark, [(0, 1), (2, 1)]))
    assert got.iterations == 33 and got.converged
    assert values(got.ranks) == pytest.approx([0.212765956574, 0.574468086852, 0.212765956574], abs=1e-12)
    assert [round(r["pct"], 6) for r in normalized(got.ranks).orderBy("node_id").collect()] == [37.037037, 100.0, 37.037037]
    writers.save_lines(writers.rank_table_lines(got.ranks), f"{tmp_path}/t")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/t").collect())[1] == "1 | 0.574468086852 | 100.000000%"
    writers.save_lines(writers.rank_lines(got.ranks), f"{tmp_path}/r")
    assert values(readers.read_ranks(spark, f"{tmp_path}/r")) == pytest.approx(values(got.ranks), abs=1e-15)


@pytest.mark.parametrize("dangling", ["redistribute", "drop"])
@pytest.mark.parametrize("k", [1, 7])
def test_against_plain_python(spark, dangling, k):
    pairs = random_graph()
    got = pagerank(edges_of(spark, pairs), dangling=dangling, max_iter=k)
    assert got.iterations == k
    assert values(got.ranks) == pytest.approx(plain(pairs, 30, k, dangling == "redistribute"), abs=1e-14)


def test_mass_and_floor(spark):
    ranks = values(pagerank(edges_of(spark, random_graph()), max_iter=12).ranks)
    assert sum(ranks) == pytest.approx(1, abs=1e-9) and min(ranks) >= 0.15 / 30
    assert sum(values(pagerank(edges_of(spark, random_graph()), dangling="drop", max_iter=12).ranks)) < 0.9


def test_renaming_nodes_renames_ranks(spark):
    pairs = random_graph(20, 60, 4)
    order = list(range(20))
    random.Random(3).shuffle(order)
    a = values(pagerank(edges_of(spark, pairs), n=20, max_iter=5).ranks)
    b = values(pagerank(edges_of(spark, [(order[s], order[t]) for s, t in pairs]), n=20, max_iter=5).ranks)
    assert [b[order[i]] for i in range(20)] == pytest.approx(a, abs=1e-14)


def test_stop_rules_and_domains(spark):
    edges = edges_of(spark, [(0, 1), (1, 0)])
    assert pagerank(edges, tol=1e-6).iterations == 1
    assert pagerank(edges, tol=1e-6, min_iter=2).iterations == 2
    assert len(pagerank(edges, tol=0.0, max_iter=3).deltas) == 3
    far = edges_of(spark, [(0, 5)])
    assert pagerank(far, max_iter=1).ranks.count() == 6
    assert pagerank(far, nodes=graph.observed_nodes(far), max_iter=1).ranks.count() == 2
    assert pagerank(edges.limit(0)).ranks.count() == 0
    with pytest.raises(ValueError, match="dangling"):
        pagerank(edges, dangling="x")


def test_every_preset_runs(spark):
    edges = edges_of(spark, [(0, 1), (1, 2), (2, 0), (2, 1)])
    for name in PRESETS:
        got = run_preset(name, edges, iterations=3, threshold=1e-3)
        assert 1 <= got.iterations <= 3 and got.ranks.count() == 3


def test_ties_go_to_the_smaller_id(spark):
    ranks = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.9)], "node_id long, rank double")
    assert [r["node_id"] for r in top_k(ranks, 2).collect()] == [2, 1]


def test_strategies_agree(spark):
    got = {r["strategy"]: r for r in compare.compare_strategies(edges_of(spark, random_graph()), n=30, limit=10).collect()}
    assert got["centralized_fixed"]["time_ms"] is None and got["distributed_fixed"]["iterations"] == 10
    assert got["distributed_fixed"]["agrees"] and got["distributed_convergence"]["agrees"]
    lines = {r["value"].split(" | ")[0]: r["value"] for r in writers.strategy_report(compare.compare_strategies(edges_of(spark, random_graph()), n=30, limit=10)).collect()}
    assert lines["centralized_fixed"].endswith("SKIPPED") and lines["distributed_fixed"].endswith("x")


def test_scaling_arithmetic(spark):
    got = compare.scaling(spark.createDataFrame([(1, 100.0), (2, 50.0), (4, 50.0)], "threads int, time_ms double")).orderBy("threads").collect()
    assert [(r["speedup"], r["efficiency"]) for r in got] == [(1, 100), (2, 100), (2, 50)]
    from pyspark.sql import functions as F

    row = spark.range(1).select(compare.data_moved_mb(F.lit(1 << 20)), compare.shared_memory_mb(F.lit(1 << 20)), compare.buffers_mb(F.lit(1 << 17), F.lit(4)), compare.lock_overhead_percent(F.lit(3.0), F.lit(2.0)), compare.lock_overhead_percent(F.lit(1.0), F.lit(2.0))).first()
    assert tuple(row) == (8, 4, 4, 50, 0)


# Growth


def grown(spark):
    old, new = random_graph(20, 50, 7), [*random_graph(20, 50, 7), (3, 20), (20, 4), (5, 6)]
    a, b = edges_of(spark, old), edges_of(spark, new)
    return old, new, graph.adjacency(graph.dense_nodes(a, 20), a), graph.adjacency(graph.dense_nodes(b, 21), b), a, b


def test_changed_nodes_and_region(spark):
    old, new, old_lists, new_lists, _, edges = grown(spark)
    seeds = incremental.changed_nodes(old_lists, new_lists)
    assert sorted(r["node_id"] for r in seeds.collect()) == [3, 5, 20]
    hops = {r["node_id"]: r["hop"] for r in incremental.active_region(seeds, edges, 2).collect()}
    want, front = {3: 0, 5: 0, 20: 0}, {3, 5, 20}
    for hop in (1, 2):
        front = {y for s, t in new for x, y in ((s, t), (t, s)) if x in front} - set(want)
        want |= dict.fromkeys(front, hop)
    assert hops == want


def test_order_of_links_matters_unless_told_otherwise(spark):
    old = spark.createDataFrame([(0, [1, 2])], "node_id long, outlinks array<long>")
    new = spark.createDataFrame([(0, [2, 1])], "node_id long, outlinks array<long>")
    assert incremental.changed_nodes(old, new).count() == 1 and incremental.changed_nodes(old, new, ordered=False).count() == 0


def test_warm_start_sums_to_one(spark):
    old, new, _, new_lists, a, _ = grown(spark)
    ranks = pagerank(a, dangling="drop", max_iter=4).ranks
    got = values(incremental.warm_start(ranks, new_lists, 21))
    assert sum(got) == pytest.approx(1, abs=1e-12) and got[20] == pytest.approx(0.15 / 21)
    none = incremental.warm_start(ranks.limit(0), new_lists, 21)
    assert sum(values(none)) == pytest.approx(21 * 0.15 / 21) or sum(values(none)) == pytest.approx(1)


def test_frozen_nodes_keep_their_rank_and_still_give(spark):
    pairs = random_graph()
    start = [(i + 1) / 465 for i in range(30)]
    active = {2, 3, 7, 11}
    init = spark.createDataFrame(list(enumerate(start)), "node_id long, rank double")
    got = pagerank(edges_of(spark, pairs), max_iter=4, init=init, active=spark.createDataFrame([(i,) for i in active], "node_id long"))
    assert values(got.ranks) == pytest.approx(plain(pairs, 30, 4, True, start, active), abs=1e-14)


def test_all_active_equals_full(spark):
    _, _, old_lists, new_lists, a, b = grown(spark)
    ranks = pagerank(a, tol=1e-12).ranks
    row = incremental.compare_full_and_incremental(old_lists, new_lists, b, ranks, hops=30, tol=1e-12).first()
    assert row["n"] == 21 and row["max_diff"] < 1e-10 and row["speedup"] > 0


def test_follower_keeps_up(spark):
    follower = RankFollower(edges_of(spark, [(0, 1), (1, 2), (2, 0)]), hops=10, tol=1e-12, max_iter=400)
    follower.add(edges_of(spark, [(0, 1)]))
    assert follower.batches == 0
    follower.add(edges_of(spark, [(2, 3), (3, 1)]))
    want = pagerank(edges_of(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 1)]), tol=1e-12, max_iter=400).ranks
    assert values(follower.ranks) == pytest.approx(values(want), abs=1e-9) and follower.top(1).count() == 1
