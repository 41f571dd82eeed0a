"""Growth in two phases, files compared, and the known figures of the two published graphs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import compare, graph
from linkloom.operators.crawl import crawl, push_links
from linkloom.operators.growth import Graph, compare_files, evaluation_report, graph_of, grow, join_by_offset, join_by_url, save_growth
from linkloom.operators.incremental import incremental_pagerank, warm_start
from linkloom.operators.pagerank import pagerank, run_preset
from linkloom.operators.policy import Budget, CrawlPolicy, capped_body, outcome
from linkloom.sources import manifest, readers, writers

# Sources of the first published graph (823 nodes) with the ranges of their targets, and of the second (1,166 nodes) what is new.
PHASE1 = {0: [(1, 1)], 2: [(3, 134)], 135: [(1, 1)], 136: [(137, 382)], 383: [(3, 3), (384, 572), (383, 383), (573, 597)], 598: [(3, 3), (599, 722)], 723: [(724, 725), (3, 3), (726, 822)]}
PHASE2 = {823: [(824, 825), (823, 823), (826, 875), (14, 14), (876, 892)], 893: [(3, 3), (894, 913), (8, 8), (914, 928), (61, 61), (929, 952), (687, 687), (953, 980)], 981: [(981, 1165)]}


def lists(spark, sources, n):
    rows = [(i, [t for a, b in sources.get(i, []) for t in range(a, b + 1)]) for i in range(n)]
    return spark.createDataFrame(rows, "node_id long, outlinks array<long>")


@pytest.fixture(scope="module")
def phases(spark):
    old, new = lists(spark, PHASE1, 823).cache(), lists(spark, PHASE1 | PHASE2, 1166).cache()
    ranks = run_preset("leaky", readers.adjacency_edges(old), n=823).ranks.cache()
    return old, new, ranks


def test_ranks_of_the_first_phase(phases):
    old, _, ranks = phases
    assert readers.adjacency_edges(old).count() == 821
    got = {r["node_id"]: r["rank"] for r in ranks.collect()}
    assert sum(got.values()) == pytest.approx(0.1510850591962445, abs=1e-14)
    assert [got[i] for i in (0, 1, 3, 4)] == pytest.approx([1.822600243013366e-04, 4.921020656136089e-04, 1.869423072889697e-04, 1.834336683972164e-04], abs=1e-17)


def test_changes_of_the_full_ranking(phases):
    _, new, _ = phases
    got = run_preset("incremental_full", readers.adjacency_edges(new), n=1166)
    assert got.deltas == pytest.approx([8.441681e-01, 6.181453e-03, 1.257245e-05, 1.101201e-07, 1.145601e-09, 1.297190e-11], rel=1e-6)
    assert got.converged and sum(r["rank"] for r in got.ranks.collect()) == pytest.approx(0.151095743685, abs=1e-12)
    top = [r["node_id"] for r in got.ranks.orderBy(F.desc("rank"), "node_id").limit(6).collect()]
    assert top == [1, 3, 14, 687, 8, 61]


def test_incremental_ranking_of_the_second_phase(phases):
    old, new, ranks = phases
    start = {r["node_id"]: r["rank"] for r in warm_start(ranks, new, 1166).collect()}
    assert start[900] == pytest.approx(1.286449e-04, rel=1e-6) and sum(start[i] for i in range(823, 1166)) == pytest.approx(4.412521e-02, rel=1e-6)
    got = incremental_pagerank(old, new, readers.adjacency_edges(new), ranks, dangling="drop")
    assert (got.affected, got.active) == (343, 916)
    assert got.ranking.deltas == pytest.approx([5.873341e-01, 3.484957e-03, 3.444723e-06, 1.368310e-08, 5.536040e-11], rel=1e-6)
    values = {r["node_id"]: r["rank"] for r in got.ranking.ranks.filter("node_id < 2").collect()}
    assert values == pytest.approx({0: 1.1531104569691352e-03, 1: 3.113398233816665e-03}, rel=1e-9)


def test_files_are_compared(spark, phases, tmp_path):
    old, new, _ = phases
    for name, x in (("old", old), ("new", new)):
        writers.save_graph(x, f"{tmp_path}/{name}", "adjacency", ["a graph", ""])
    result = compare_files(spark, f"{tmp_path}/old", f"{tmp_path}/new", dangling="drop")
    row = result.first()
    assert (row["affected"], row["active"], row["nodes"], row["new_nodes"], row["full_iterations"], row["incremental_iterations"]) == (343, 916, 1166, 343, 6, 5)
    assert row["avg_diff"] == pytest.approx(2.2189405e-04, rel=1e-5) and row["max_diff"] == pytest.approx(2.7660569e-03, rel=1e-5)
    said = [r["value"] for r in evaluation_report(result).collect()]
    assert len(said) == 5 and "343 nodes (29.4%), active: 916, new: 343" in said[2]


def html(*targets):
    return "".join(f'<a href="{t}">' for t in targets)


def pages(spark, links):
    return spark.createDataFrame([(u, html(*t)) for u, t in links.items()], "url string, html string")


def seeds(spark, *urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "seq long, url string")


WEB = {"http://a/": ["http://b/", "http://c/"], "http://b/": ["http://A/"], "http://d/": ["http://B/", "http://e/"], "http://e/": []}


@pytest.mark.parametrize("by", ["offset", "url"])
def test_two_phases(spark, by, tmp_path):
    fetches = pages(spark, WEB)
    one = crawl(seeds(spark, "http://a/"), fetches)
    first = graph_of(one.links)
    got = grow(first, seeds(spark, "http://d/", "HTTP://A/"), fetches, by=by, earlier=one, max_iter=5)
    assert {r["url"] for r in got.crawl.states.collect()} == {"http://d/", "http://e/"}  # http://b/ was seen by the first crawl
    urls = {r["node_id"]: r["url"] for r in got.graph.nodes.collect()}
    edges = {(urls[r["src"]], urls[r["dst"]]) for r in got.graph.edges.collect()}
    assert edges == {("http://a/", "http://b/"), ("http://a/", "http://c/"), ("http://b/", "http://a/"), ("http://d/", "http://B/" if by == "offset" else "http://b/"), ("http://d/", "http://e/")}
    assert sorted(urls) == list(range(6 if by == "offset" else 5)) and [urls[i] for i in range(3)] == ["http://a/", "http://b/", "http://c/"]
    assert got.metadata == {"phase1_node_count": 3, "phase1_edge_count": 3, "phase2_total_nodes": len(urls), "phase2_total_edges": 5}
    assert sum(r["rank"] for r in got.ranks.collect()) == pytest.approx(1)
    save_growth(got, first, str(tmp_path))
    assert readers.read_metadata(spark, f"{tmp_path}/phase2_metadata") == got.metadata
    assert sorted(readers.read_edges(spark, f"{tmp_path}/phase2_graph.edge").collect()) == sorted(got.graph.edges.collect())
    assert readers.read_url_map(spark, f"{tmp_path}/phase2_url_map").count() == len(urls)
    with pytest.raises(ValueError, match="join"):
        grow(first, seeds(spark, "http://d/"), fetches, by="name")


def test_joins_of_empty_and_equal_graphs(spark):
    one = graph_of(crawl(seeds(spark, "http://a/"), pages(spark, WEB)).links)
    empty = Graph(spark.createDataFrame([], "node_id long, url string"), spark.createDataFrame([], "src long, dst long"))
    for joined in (join_by_url(one, one), join_by_url(one, empty), join_by_offset(one, empty), join_by_url(empty, one)):
        assert joined.nodes.count() == 3 and joined.edges.count() == 3
    assert join_by_offset(one, one).edges.count() == 6


def test_a_recrawl_leaves_out_what_was_seen_and_has_a_budget_of_its_own(spark):
    fetches = pages(spark, {"http://s/": [f"http://x{i}/" for i in range(9)]})
    policy = CrawlPolicy(max_pages=4)
    one = crawl(seeds(spark, "http://s/"), fetches, policy)
    assert one.discovered == 4
    again = crawl(seeds(spark, "http://s/", "http://t/"), fetches, policy, seen=one.states)
    assert [r["url"] for r in again.states.collect()] == ["http://t/"]


def test_fetches_may_come_from_a_function(spark):
    asked = []

    def live(urls):
        asked.append(sorted(r["url"] for r in urls.collect()))
        return urls.select("url", F.when(F.col("url") == "http://s/", F.lit(html("http://t/", "http://u/"))).alias("html"), F.when(F.col("url") == "http://u/", "TIMEOUT").otherwise("OK").alias("outcome"))

    got = crawl(seeds(spark, "http://s/"), live)
    assert asked == [["http://s/"], ["http://t/", "http://u/"]]
    assert {r["url"]: r["state"] for r in got.states.collect()} == {"http://s/": "DONE", "http://t/": "DONE", "http://u/": "FAILED"}


def test_push_tells_how_many_were_accepted(spark):
    urls = spark.createDataFrame([("http://example.com", 0, 0), ("http://EXAMPLE.com", 0, 1), ("http://example.com/page", 0, 2), ("http://example.com", 0, 3)], "url string, depth int, place long")
    queued, n = push_links(urls, spark.createDataFrame([], "url_key string"))
    assert n == 2 and [r["url"] for r in queued.orderBy("seq").collect()] == ["http://example.com", "http://example.com/page"]


def test_errors_go_before_the_status_and_bodies_are_cut_by_bytes(spark):
    rows = [(200, "text/html", None), (200, "text/html", "timeout"), (0, None, "connect"), (200, "text/html", "tls"), (200, "text/html", "truncated"), (200, "image/png", None), (301, None, None)]
    df = spark.createDataFrame(rows, "code int, kind string, error string")
    got = [r[0] for r in df.select(outcome(F.col("code"), F.col("kind"), F.col("error"))).collect()]
    assert got == ["OK", "TIMEOUT", "TIMEOUT", "ERROR", "OK", "CONTENT_SKIP", "REDIRECT"]
    df = spark.createDataFrame([("abcdef",), ("éé",), (None,), ("aé漢",)], "body string")
    assert [r[0] for r in df.select(capped_body(F.col("body"), 4)).collect()] == ["abcd", "éé", None, "aé�"]


def test_vertex_and_edge_files_are_converted(spark, tmp_path):
    spark.createDataFrame([("0",), ("1",), ("2",)], "value string").write.text(f"{tmp_path}/v")
    spark.createDataFrame([("0 1",), ("0 2",), ("2 7",), ("1 1",)], "value string").write.text(f"{tmp_path}/e")
    assert writers.converted(spark, f"{tmp_path}/v", f"{tmp_path}/e", f"{tmp_path}/out") == (3, 3)
    lists_ = readers.read_adjacency(spark, f"{tmp_path}/out/graph.adj")
    assert {r["node_id"]: r["outlinks"] for r in lists_.collect()} == {0: [1, 2], 1: [1], 2: []}
    assert sorted(tuple(r) for r in readers.read_edges(spark, f"{tmp_path}/out/graph.edge").collect()) == [(0, 1), (0, 2), (1, 1)]
    urls = {r["node_id"]: r["url"] for r in readers.read_url_map(spark, f"{tmp_path}/out/url_map").collect()}
    assert urls[2] == "http://graph500-node-2.synthetic/" and len(urls) == 3


def test_manifest_blocks_are_appended_and_read_back(spark, tmp_path):
    path, settings = f"{tmp_path}/m", {"mode": "compare", "profile": "small", "threads": 4, "max_depth": 1, "max_pages": 50}
    run = manifest.Run(1234.5, 8, 30, 20, 100, 200)
    manifest.append_manifest(spark, path, settings, ["http://a/"], {"THREADED": run, "MANUAL": manifest.Run(2469.0, 8, 30, 20, 100, 201)}, datetime(2024, 1, 2, 3, 4, 5))
    manifest.append_manifest(spark, path, settings | {"mode": "manual"}, ["http://a/"], {"MANUAL": run}, datetime(2024, 1, 2, 3, 4, 6))
    got = sorted((r["mode"], r["section"], r["threads"], r["max_pages"], r["elapsed_ms"], r["discovered"], r["edges"]) for r in manifest.read_manifest(spark, path).collect())
    assert got == [("compare", "MANUAL", 4, 50, 2469.0, 30, 201), ("compare", "THREADED", 4, 50, 1234.5, 30, 200), ("manual", "MANUAL", 4, 50, 1234.5, 30, 200)]
    assert "Speedup (manual/threaded): 2.00x" in manifest.block(settings, [], {"THREADED": run, "MANUAL": manifest.Run(2469.0, 8, 30, 20, 100, 201)})


def test_a_hub_is_dealt_to_several_tasks(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(i, 0) for i in range(1, 30)], "src long, dst long")
    plain = {r["node_id"]: r["rank"] for r in pagerank(edges, max_iter=12).ranks.collect()}
    split = {r["node_id"]: r["rank"] for r in pagerank(edges, max_iter=12, hub_edges=7).ranks.collect()}
    assert split == pytest.approx(plain, abs=1e-15)
    assert graph.node_count(edges) == 40


def test_lines_are_copied_and_appended_and_ranks_shown(spark, tmp_path, capsys):
    spark.createDataFrame([("a",), ("b",)], "value string").write.text(f"{tmp_path}/x")
    writers.copy_lines(spark, f"{tmp_path}/x", f"{tmp_path}/y")
    writers.copy_lines(spark, f"{tmp_path}/x", f"{tmp_path}/y", "append")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/y").collect()) == ["a", "a", "b", "b"]
    ranks = spark.createDataFrame([(0, 0.25), (1, 0.5), (2, 0.25)], "node_id long, rank double")
    said = writers.show_ranks(ranks, 2)
    assert said.split("\n") == ["node_1 | 0.500000000000 | 100.000000%", "node_0 | 0.250000000000 | 50.000000%"] and said in capsys.readouterr().out


def test_a_budget_records_fetches_and_stops_a_crawl(spark):
    fetches = pages(spark, {"http://s/": ["http://x/"]})
    budget = Budget()
    assert crawl(seeds(spark, "http://s/"), fetches, budget=budget).fetched == 2 and budget.fetched == 2
    budget.stopped = True
    assert crawl(seeds(spark, "http://s/"), fetches, budget=budget).fetched == 0
    budget.reset()
    assert budget.may_continue(CrawlPolicy(max_pages=1))
    budget.record()
    assert not budget.may_continue(CrawlPolicy(max_pages=1))


def test_reports_name_the_first_nodes(spark):
    got = compare.compare_strategies(spark.createDataFrame([(0, 1), (2, 1)], "src long, dst long"), n=3, iterations=3, limit=1)
    said = [r["value"] for r in writers.strategy_report(got).collect()]
    assert any(x.endswith("SKIPPED") for x in said) and sum(x.startswith("    node_1: ") for x in said) == 2


def test_local_timestamp(spark):
    said = spark.range(1).select(text.local_timestamp()).first()[0]
    assert datetime.strptime(said, "%Y-%m-%d %H:%M:%S").year > 2000
