import random

import pytest

from linkloom.lineage import with_index, with_prefix_sum
from linkloom.operators import graph
from linkloom.sources import readers, writers


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_build_keeps_first_spelling_and_drops_repeated_edges(spark):
    names = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "e"), ("c", "A"), ("d", "e"), ("e", "a"), ("e", "B"), ("a", "b")]
    links = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(names)], "seq long, src_url string, dst_url string")
    nodes = graph.node_ids(links)
    assert [r["url"] for r in nodes.orderBy("node_id").collect()] == ["a", "b", "c", "d", "e"]
    edges = graph.edges_of(links, nodes)
    assert edges.count() == 9
    stats = graph.graph_stats(nodes, edges).first()
    assert (stats["n_nodes"], stats["n_edges"], stats["n_dangling"], stats["max_out_degree"], stats["n_self_loops"]) == (5, 9, 0, 3, 0)
    found = graph.lookup_ids(spark.createDataFrame([("C",), ("zz",)], "url string"), nodes)
    assert {r["url"]: r["node_id"] for r in found.collect()} == {"C": 2, "zz": None}


def test_index_and_prefix_sum_over_many_partitions(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v long, w long").repartition(9)
    assert all(r["v"] == r["i"] for r in with_index(df, ["v"], "i").collect())
    sums = {r["v"]: r["s"] for r in with_prefix_sum(df, ["v"], "w", "s").collect()}
    assert all(sums[v] == sum(x % 7 for x in range(v)) for v in range(0, 500, 37))


def test_degrees_and_layouts(spark):
    edges = edges_of(spark, [(0, 1), (0, 1), (0, 2), (2, 2)])
    nodes = graph.dense_nodes(edges, graph.node_count(edges))
    assert rows(graph.out_degree(edges)) == [(0, 3), (2, 1)] and rows(graph.in_degree(edges)) == [(1, 2), (2, 2)]
    assert rows(graph.dangling_nodes(nodes, edges)) == [(1,)]
    assert rows(graph.csr_row_ptr(nodes, edges)) == [(0, 0, 3), (1, 3, 3), (2, 3, 4)]
    assert rows(graph.distinct_edges(edges)) == [(0, 1), (0, 2), (2, 2)]
    assert graph.undirected(edges).filter("src = 2 and dst = 2").count() == 2
    assert rows(graph.valid_edges(edges_of(spark, [(0, 9), (0, 1), (9, 0)]), 2)) == [(0, 1)]
    assert rows(graph.valid_edges(edges_of(spark, [(0, 9), (0, 1), (9, 0)]), 2, strict_dst=False)) == [(0, 1), (0, 9)]
    assert graph.node_count(edges.limit(0)) == 0


def test_adjacency_order_union_and_offset(spark):
    edges = spark.createDataFrame([(0, 2, 1), (0, 1, 2)], "src long, dst long, seq long")
    nodes = graph.dense_nodes(edges, 3)
    assert {r["node_id"]: r["outlinks"] for r in graph.adjacency(nodes, edges, "seq").collect()} == {0: [2, 1], 1: [], 2: []}
    lists = graph.adjacency(nodes, edges)
    assert rows(graph.explode_adjacency(lists)) == [(0, 0, 1), (0, 1, 2)]
    assert rows(graph.union_graphs(edges, edges, 10)) == [(0, 1), (0, 2), (10, 11), (10, 12)]
    assert {r["node_id"]: r["outlinks"] for r in graph.offset_adjacency(lists, 5).collect()} == {5: [6, 7], 6: [], 7: []}
    assert {r["node_id"]: r["inlinks"] for r in graph.reverse_adjacency(nodes, edges).collect()} == {0: [], 1: [0], 2: [0]}


def test_text_round_trips(spark, tmp_path):
    edges = edges_of(spark, [(0, 1), (0, 2), (2, 0)])
    lists = graph.adjacency(graph.dense_nodes(edges, 4), edges)
    writers.save_graph(lists, f"{tmp_path}/adj", "adjacency", ["a graph", "", "3: not a line: of data"])
    back = {r["node_id"]: r["outlinks"] for r in readers.read_adjacency(spark, f"{tmp_path}/adj").collect()}
    assert back == {0: [1, 2], 1: [], 2: [0], 3: []}
    writers.save_graph(edges, f"{tmp_path}/edge", "edgelist")
    assert rows(readers.read_edges(spark, f"{tmp_path}/edge")) == rows(edges)
    assert readers.read_edges(spark, f"{tmp_path}/edge", undirected=True).count() == 6
    with pytest.raises(ValueError, match="unknown graph format"):
        writers.save_graph(edges, f"{tmp_path}/x", "other")
    writers.save_lines(writers.url_map_lines(spark.createDataFrame([(0, "http://a b"), (1, "c")], "node_id long, url string")), f"{tmp_path}/map")
    assert rows(readers.read_url_map(spark, f"{tmp_path}/map")) == [(0, "http://a"), (1, "c")]
    writers.save_key_values(spark, f"{tmp_path}/meta", {"phase1_node_count": 5, "note": "x"})
    assert readers.read_metadata(spark, f"{tmp_path}/meta") == {"phase1_node_count": 5}
    assert writers.synthetic_urls(2, spark).count() == 2


def test_line_endings_repeated_ids_and_bad_targets(spark, tmp_path):
    (tmp_path / "g.adj").write_bytes(b"# head\r\n\r\n0:1,2\r\n1:\r\n0:7\r\nnoise\r\n2:" + b",".join(b"%d" % (i % 3) for i in range(5000)) + b"\r\n")
    path = str(tmp_path / "g.adj")
    got = {r["node_id"]: r["outlinks"] for r in readers.read_adjacency(spark, path, n=3).collect()}
    assert got[0] == [1, 2] and got[1] == [] and len(got[2]) == 5000
    assert {r["node_id"]: r["outlinks"] for r in readers.read_adjacency(spark, path, "overwrite").collect()}[0] == [7]
    (tmp_path / "v").write_text("0\n1\n2\n")
    (tmp_path / "e").write_text("0 1\n1 9\n9 1\n2 0\n")
    nodes, edges = readers.read_vertex_edge(spark, str(tmp_path / "v"), str(tmp_path / "e"))
    assert nodes.count() == 3 and rows(edges) == [(0, 1), (2, 0)]
    assert rows(readers.read_vertex_edge(spark, str(tmp_path / "v"), str(tmp_path / "e"), strict_dst=False)[1]) == [(0, 1), (1, 9), (2, 0)]


def test_neighbours(spark):
    edges = edges_of(spark, [(0, 1), (1, 2), (3, 1)])
    visited = spark.createDataFrame([(1,), (2,)], "node_id long")
    assert rows(graph.neighbours(spark.createDataFrame([(1,)], "node_id long"), graph.undirected(edges), visited)) == [(0,), (3,)]
