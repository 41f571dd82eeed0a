"""More of the query catalogue: files written and read back, fetch outcomes, growing graphs, further strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import hashing, text
from linkloom.operators import compare, crawl, graph, growth, incremental, pagerank, policy
from linkloom.plans.catalogue import EVENTS, LINKS, NODES, PHASES, WARM, _lists, _user_pages, rank_steps, rounded
from linkloom.plans.graphs import event_graph, first_phase_pages, page_links, table, two_phases, web_graph
from linkloom.sources import manifest, readers, writers
from linkloom.streaming.frontier import shared_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Files ---------------------------------------------------------------------------------------------


@query(f"WITH {EVENTS} SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges")
def undirected_edge_file(spark, sf_dir):
    path = shared_path(spark, "edges")
    writers.save_graph(event_graph(spark, sf_dir), path, "edgelist")
    return readers.read_edges(spark, path, undirected=True)


def _vertex_edge_files(spark, sf_dir, strict):
    """A vertex file with the first half of the nodes, and all edges."""
    edges = event_graph(spark, sf_dir)
    v, e = shared_path(spark, "v"), shared_path(spark, "e")
    writers.save_lines(spark.range(graph.node_count(edges) // 2).select(F.col("id").cast("string").alias("value")), v)
    writers.save_graph(edges, e, "edgelist")
    return readers.read_vertex_edge(spark, v, e, strict)[1]


HALF = "k AS (SELECT (max(greatest(src, dst)) + 1) // 2 AS k FROM edges)"


@query(f"WITH {EVENTS}, {HALF} SELECT src, dst FROM edges, k WHERE src < k AND dst < k")
def vertex_edge_files(spark, sf_dir):
    return _vertex_edge_files(spark, sf_dir, True)


@query(f"WITH {EVENTS}, {HALF} SELECT src, dst FROM edges, k WHERE src < k")
def vertex_edge_files_any_target(spark, sf_dir):
    return _vertex_edge_files(spark, sf_dir, False)


@query(f"WITH {EVENTS} SELECT src, max(dst) AS dst FROM edges GROUP BY src")
def adjacency_file_overwritten(spark, sf_dir):
    """Lists written twice into one file; the later line of an id counts."""
    edges, path = event_graph(spark, sf_dir), shared_path(spark, "lists")
    whole = graph.adjacency(graph.observed_nodes(edges), edges).filter(F.size("outlinks") > 0)
    last = whole.select("node_id", F.slice("outlinks", -1, 1).alias("outlinks"))
    writers.save_graph(whole.coalesce(1).unionByName(last.coalesce(1)).coalesce(1), path, "adjacency")
    return readers.adjacency_edges(readers.read_adjacency(spark, path, repeated="overwrite"))


@query(f"WITH {NODES} SELECT node_id, url FROM nodes")
def url_map_round_trip(spark, sf_dir):
    path = shared_path(spark, "map")
    writers.save_lines(writers.url_map_lines(web_graph(spark, sf_dir)[0]), path)
    return readers.read_url_map(spark, path)


@query(f"WITH {NODES} SELECT node_id + 1000 AS node_id, url FROM nodes")
def url_map_offset(spark, sf_dir):
    path = shared_path(spark, "map")
    writers.save_lines(writers.offset_url_map_lines(web_graph(spark, sf_dir)[0], 1000), path)
    return readers.read_url_map(spark, path)


@query(f"WITH {EVENTS}, {rank_steps(6, True)} SELECT node_id, round(r, 9) AS rank FROM r6")
def raw_rank_round_trip(spark, sf_dir):
    path = shared_path(spark, "ranks")
    writers.save_lines(writers.rank_lines(pagerank.pagerank(event_graph(spark, sf_dir), max_iter=6).ranks), path)
    return rounded(readers.read_ranks(spark, path), 9)


@query(f"""WITH {EVENTS}, {HALF} SELECT k::BIGINT AS n_nodes, (SELECT count(*) FROM edges WHERE src < k AND dst < k) AS n_edges,
(SELECT count(*) FROM edges WHERE src < k AND dst < k) AS read_edges, k::BIGINT AS read_urls FROM k""")
def converted_files(spark, sf_dir):
    """Vertex and edge files as adjacency lists, edge list and URL map."""
    edges = event_graph(spark, sf_dir)
    v, e, out = (shared_path(spark, x) for x in "veo")
    writers.save_lines(spark.range(graph.node_count(edges) // 2).select(F.col("id").cast("string").alias("value")), v)
    writers.save_graph(edges, e, "edgelist")
    counts = writers.converted(spark, v, e, out)
    read = readers.adjacency_edges(readers.read_adjacency(spark, f"{out}/graph.adj")).agg(F.count(F.lit(1)).alias("read_edges"))
    urls = readers.read_url_map(spark, f"{out}/url_map").agg(F.count(F.lit(1)).alias("read_urls"))
    return spark.createDataFrame([counts], "n_nodes long, n_edges long").crossJoin(F.broadcast(read)).crossJoin(F.broadcast(urls))


@query(f"""WITH {PHASES} SELECT 'phase1_node_count' AS key, count(*)::VARCHAR AS value FROM nodes1 UNION ALL SELECT 'phase1_edge_count', count(*)::VARCHAR FROM edges1
UNION ALL SELECT 'phase2_total_nodes', count(*)::VARCHAR FROM nodes UNION ALL SELECT 'phase2_total_edges', count(*)::VARCHAR FROM edges""")
def phase_metadata(spark, sf_dir):
    nodes, early, edges = two_phases(spark, sf_dir)
    path = shared_path(spark, "metadata")
    counts = {"phase1_node_count": graph.observed_nodes(early), "phase1_edge_count": early, "phase2_total_nodes": nodes, "phase2_total_edges": edges}
    writers.save_key_values(spark, path, {k: v.count() for k, v in counts.items()})
    return readers.read_key_values(spark, path)


@query(f"""WITH {NODES}, n AS (SELECT count(*) AS n FROM nodes), e AS (SELECT count(*) AS e FROM edges)
SELECT mode, section, n AS nodes, e AS edges, 12.5::DOUBLE AS elapsed_ms FROM n, e, (VALUES ('compare', 'THREADED'), ('compare', 'MANUAL'), ('manual', 'MANUAL')) v(mode, section)""")
def manifest_round_trip(spark, sf_dir):
    """Two runs appended to a manifest and read back."""
    nodes, edges = web_graph(spark, sf_dir)
    run = manifest.Run(12.5, 1, 2, 3, nodes.count(), edges.count())
    path = shared_path(spark, "manifest")
    for mode, sections in (("compare", ("THREADED", "MANUAL")), ("manual", ("MANUAL",))):
        manifest.append_manifest(spark, path, {"mode": mode, "profile": "small", "threads": 1, "max_depth": 0, "max_pages": 50}, ["http://example.com/"], dict.fromkeys(sections, run))
    return manifest.read_manifest(spark, path).select("mode", "section", "nodes", "edges", "elapsed_ms")


# Fetches and text ----------------------------------------------------------------------------------

KINDS = ["text/html", "image/png", "application/xhtml+xml; q=1", "", "text/plain"]
ERRORS = [None, "timeout", "truncated", "tls", None, "connect", None]


@query(f"""WITH f AS (SELECT event_id, {KINDS}[(event_id % {len(KINDS)} + 1)::INT] AS kind, {str(ERRORS).replace("None", "NULL")}[(event_id % {len(ERRORS)} + 1)::INT] AS error, CASE WHEN event_id % 4 = 3 THEN 404 ELSE 200 END AS code FROM events)
SELECT event_id, CASE WHEN error IN ('timeout', 'connect') THEN 'TIMEOUT' WHEN error <> 'truncated' THEN 'ERROR' WHEN code = 404 THEN 'NOT_FOUND'
  WHEN contains(kind, 'text/html') OR contains(kind, 'application/xhtml') THEN 'OK' ELSE 'CONTENT_SKIP' END AS outcome FROM f""")
def fetch_outcomes(spark, sf_dir):
    """Outcomes of made-up fetches: errors first, then the status, then the kind of content."""
    pick = lambda values: F.get(F.array(*(F.lit(v).cast("string") for v in values)), (F.col("event_id") % len(values)).cast("int"))
    code = F.when(F.col("event_id") % 4 == 3, 404).otherwise(200)
    return table(spark, sf_dir, "events").select("event_id", policy.outcome(code, pick(KINDS), pick(ERRORS)).alias("outcome"))


@query("SELECT page_id, left(url, 20) AS body FROM pages")
def body_cap(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", policy.capped_body(F.col("url"), 20).alias("body"))


@query("SELECT event_id, 'text/html; n=' || event_id AS content_type FROM events")
def header_content_type(spark, sf_dir):
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\ncontent-TYPE:  text/html; n="), F.col("event_id").cast("string"), F.lit("\r\nX-Other: y\r\n"))
    return table(spark, sf_dir, "events").select("event_id", policy.header_content_type(headers).alias("content_type"))


@query("SELECT page_id, contains(lower(url), 'page') AS has_page, left(url, 12) AS short, lower(url) = lower(upper(url)) AS same FROM pages")
def text_functions(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.contains_ignoring_case(url, F.lit("PAGE")).alias("has_page"), text.truncated(url, 12).alias("short"), text.equals_ignoring_case(url, F.upper(url)).alias("same"))


@query("""SELECT page_id, (list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(lower(url), ''), lambda c: ascii(c)::HUGEINT)),
  lambda h, x: (h * 33 + x) % 18446744073709551616::HUGEINT) % 1009)::BIGINT AS bucket FROM pages""")
def url_buckets(spark, sf_dir):
    """Buckets of a table of URLs by the hash of their keys."""
    return table(spark, sf_dir, "pages").select("page_id", (hashing.string_hash_of(F.col("url")) % 1009).cast("long").alias("bucket"))


@query(f"WITH {EVENTS}, {HALF} SELECT src, dst FROM edges, k WHERE src BETWEEN 0 AND k - 1 AND dst BETWEEN 0 AND k - 1")
def valid_edges(spark, sf_dir):
    edges = event_graph(spark, sf_dir)
    return graph.valid_edges(edges, graph.node_count(edges) // 2)


@query("""WITH t AS (SELECT n_nationkey + 1 AS threads, 1000.0::DOUBLE / (n_nationkey + 1) + n_regionkey AS time_ms FROM nation),
b AS (SELECT threads, time_ms, (SELECT arg_min(time_ms, threads) FROM t) / time_ms AS speedup FROM t) SELECT threads, round(speedup, 9) AS speedup, round(100 * speedup / threads, 9) AS efficiency FROM b""")
def thread_scaling(spark, sf_dir):
    """Speedup and efficiency of made-up timings."""
    timings = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("threads"), (1000.0 / (F.col("n_nationkey") + 1) + F.col("n_regionkey")).alias("time_ms"))
    return compare.scaling(timings).select("threads", F.round("speedup", 9).alias("speedup"), F.round("efficiency", 9).alias("efficiency"))


# Crawls and growth ---------------------------------------------------------------------------------

SEEN = """seen AS (SELECT 0::BIGINT AS id UNION SELECT dst FROM edges WHERE src = 0),
s AS (SELECT DISTINCT src AS id FROM edges WHERE src IN (1, 2, 3) AND src NOT IN (SELECT id FROM seen)),
n AS (SELECT DISTINCT dst AS id FROM edges JOIN s ON src = s.id WHERE dst NOT IN (SELECT id FROM seen) AND dst NOT IN (SELECT id FROM s))"""


@query(f"WITH {EVENTS}, {SEEN} SELECT 'u' || id AS url, 0 AS depth FROM s UNION ALL SELECT 'u' || id, 1 FROM n")
def recrawl(spark, sf_dir):
    """A second crawl of one level that leaves out what the first has seen."""
    pages, one_level = _user_pages(spark, sf_dir), policy.CrawlPolicy(max_depth=1, links_per_page=None)
    first = crawl.crawl(spark.createDataFrame([("u0",)], "url string"), pages, one_level)
    known = pages.select("url").filter(F.col("url").isin("u1", "u2", "u3"))
    return crawl.crawl(known, pages, one_level, seen=first.states).states.select("url", "depth")


@query(f"WITH {EVENTS}, l1 AS (SELECT DISTINCT dst FROM edges WHERE src = 0 AND dst <> 0) SELECT 2 AS levels, (SELECT count(*) FROM l1) + 1 AS discovered, (SELECT count(*) FROM l1) + 1 AS fetched")
def crawl_counters(spark, sf_dir):
    got = crawl.crawl(spark.createDataFrame([("u0",)], "url string"), _user_pages(spark, sf_dir), policy.CrawlPolicy(max_depth=1, links_per_page=None))
    return spark.createDataFrame([(got.levels, got.discovered, got.fetched)], "levels int, discovered long, fetched long")


def _graph_sql(p: str, where: str) -> str:
    """CTEs {p}nodes and {p}edges of the pages for which where holds, with ids of their own."""
    return f"""{p}links AS (SELECT * FROM links WHERE page_id {where} (SELECT floor((max(page_id) + 1) * (1 - 0.02::DOUBLE)) FROM pages)),
{p}ends AS (SELECT (page_id * 256 + pos) * 2 AS spot, url FROM {p}links UNION ALL SELECT (page_id * 256 + pos) * 2 + 1, link FROM {p}links),
{p}firsts AS (SELECT lower(url) AS url_key, min(spot) AS first, arg_min(url, spot) AS url FROM {p}ends GROUP BY lower(url)),
{p}nodes AS (SELECT row_number() OVER (ORDER BY first) - 1 AS node_id, url, url_key FROM {p}firsts),
{p}edges AS (SELECT DISTINCT a.node_id AS src, b.node_id AS dst FROM {p}links l JOIN {p}nodes a ON a.url_key = lower(l.url) JOIN {p}nodes b ON b.url_key = lower(l.link))"""


GROWN = f"{LINKS}, {_graph_sql('a_', '<')}, {_graph_sql('b_', '>=')}"


def _two_graphs(spark, sf_dir):
    """Graphs of the pages of the first and of the second phase, each with ids of its own."""
    found = page_links(spark, sf_dir)
    early = first_phase_pages(found)
    late = found.join(early.select("page_id").distinct(), "page_id", "left_anti")
    links = lambda x: x.select((F.col("page_id") * 256 + F.col("pos")).alias("seq"), F.col("url").alias("src_url"), F.col("link").alias("dst_url"))
    return growth.graph_of(links(early)), growth.graph_of(links(late))


@query(f"WITH {GROWN}, n AS (SELECT count(*) AS n FROM a_nodes) SELECT src, dst FROM a_edges UNION ALL SELECT src + n, dst + n FROM b_edges, n")
def growth_by_offset(spark, sf_dir):
    return growth.join_by_offset(*_two_graphs(spark, sf_dir)).edges


@query(f"""WITH {GROWN}, n AS (SELECT count(*) AS n FROM a_nodes),
ids AS (SELECT b.node_id, coalesce(a.node_id, n + row_number() OVER (PARTITION BY a.node_id IS NULL ORDER BY b.node_id) - 1) AS id FROM b_nodes b LEFT JOIN a_nodes a USING (url_key), n)
SELECT src, dst FROM a_edges UNION SELECT x.id, y.id FROM b_edges JOIN ids x ON x.node_id = src JOIN ids y ON y.node_id = dst""")
def growth_by_url(spark, sf_dir):
    return growth.join_by_url(*_two_graphs(spark, sf_dir)).edges


# Strategies ----------------------------------------------------------------------------------------


@query(f"WITH {NODES}, {rank_steps(30, False)} SELECT node_id, round(r, 8) AS rank FROM r30")
def pagerank_leaky(spark, sf_dir):
    """Dangling rank is lost; iterated until nothing moves."""
    nodes, edges = web_graph(spark, sf_dir)
    return rounded(pagerank.run_preset("leaky", edges, nodes=nodes.select("node_id")).ranks, 8)


@query(f"WITH {EVENTS}, {rank_steps(12, True)} SELECT node_id, round(r, 10) AS rank FROM r12")
def pagerank_csr_fixed(spark, sf_dir):
    return rounded(pagerank.run_preset("csr_fixed", event_graph(spark, sf_dir), iterations=12).ranks)


DELTAS = "deltas AS (" + " UNION ALL ".join(f"SELECT {i + 1} AS i, (SELECT sum(abs(b.r - a.r)) FROM r{i} a JOIN r{i + 1} b USING (node_id)) AS delta" for i in range(12)) + ")"


@query(f"WITH {EVENTS}, {rank_steps(12, True)}, {DELTAS} SELECT name AS strategy, greatest(least, (SELECT min(i) FROM deltas WHERE delta < tol)) AS iterations FROM (VALUES ('parallel', 1e-3, 1), ('centralized_convergence', 1e-3, 1), ('csr_convergence', 1e9, 2), ('sequential', 1e-2, 1)) v(name, tol, least)")
def stop_rules(spark, sf_dir):
    """How many iterations converging strategies take until the change is below a threshold."""
    edges, rows = event_graph(spark, sf_dir), []
    for name, tol in (("parallel", 1e-3), ("centralized_convergence", 1e-3), ("csr_convergence", 1e9), ("sequential", 1e-2)):
        rows.append((name, pagerank.run_preset(name, edges, threshold=tol).iterations))
    return spark.createDataFrame(rows, "strategy string, iterations int")


@query(f"WITH {PHASES}, {rank_steps(10, False, 'o', 'edges1', 'nodes1')}, {rank_steps(5, False, 'n', start=WARM, active='h3')} SELECT node_id, round(r, 10) AS rank FROM nr5")
def pagerank_incremental_drop(spark, sf_dir):
    """Incremental ranks where dangling rank is lost: frozen nodes keep their old rank, scaled up."""
    old, new, early, edges = _lists(spark, sf_dir)
    ranks = pagerank.pagerank(early, nodes=old.select("node_id"), dangling="drop", max_iter=10).ranks
    return rounded(incremental.incremental_pagerank(old, new, edges, ranks, dangling="drop", tol=None, max_iter=5).ranking.ranks)
