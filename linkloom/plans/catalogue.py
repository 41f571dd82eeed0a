"""The query catalogue: every operator over the standard tables, and the same in SQL where SQL can say it.

Ranks are rounded, since sums in another order differ in the last digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.hashing import list_hash_of
from linkloom.operators import compare, crawl, graph, incremental, links, pagerank, policy
from linkloom.plans.graphs import event_graph, first_phase_pages, order_graph, page_links, table, two_phases, url_links, web_graph
from linkloom.sources import readers, writers
from linkloom.sources.seeds import PROFILES
from linkloom.streaming import frontier

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Parts of SQL that several queries share.
LINKS = r"""
raw AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a[^>]*?href=("[^"]*|''[^'']*|[^\s>]*)', 1) AS hs FROM pages),
hrefs AS (SELECT page_id, url, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM raw),
cut AS (SELECT page_id, url, i, left(regexp_replace(h, '^["'']', ''), 4095) AS link FROM hrefs),
ranked AS (SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM cut
           WHERE length(link) > 0 AND NOT regexp_matches(link, '^(javascript:|mailto:|tel:|#)')),
links AS (SELECT page_id, url, pos, link FROM ranked WHERE pos < 256)"""
NODES = (
    LINKS
    + """,
ends AS (SELECT (page_id * 256 + pos) * 2 AS spot, url FROM links UNION ALL SELECT (page_id * 256 + pos) * 2 + 1, link FROM links),
firsts AS (SELECT lower(url) AS url_key, min(spot) AS first, arg_min(url, spot) AS url FROM ends GROUP BY lower(url)),
nodes AS (SELECT row_number() OVER (ORDER BY first) - 1 AS node_id, url, url_key FROM firsts),
edges AS (SELECT DISTINCT a.node_id AS src, b.node_id AS dst FROM links l JOIN nodes a ON a.url_key = lower(l.url) JOIN nodes b ON b.url_key = lower(l.link))"""
)
EVENTS = """
edges AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst),
nodes AS (SELECT unnest(range(0, (SELECT max(greatest(src, dst)) + 1 FROM edges))) AS node_id)"""
ORDERS = """
edges AS (SELECT DISTINCT o_custkey AS src, l_suppkey + (SELECT max(c_custkey) + 1 FROM customer) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
nodes AS (SELECT src AS node_id FROM edges UNION SELECT dst FROM edges)"""
PHASES = (
    NODES
    + """,
early AS (SELECT * FROM links WHERE page_id < (SELECT floor((max(page_id) + 1) * (1 - 0.02::DOUBLE)) FROM pages)),
edges1 AS (SELECT DISTINCT a.node_id AS src, b.node_id AS dst FROM early l JOIN nodes a ON a.url_key = lower(l.url) JOIN nodes b ON b.url_key = lower(l.link)),
nodes1 AS (SELECT src AS node_id FROM edges1 UNION SELECT dst FROM edges1),
lists1 AS (SELECT n.node_id, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS outs FROM nodes1 n LEFT JOIN edges1 ON src = n.node_id GROUP BY n.node_id),
lists2 AS (SELECT n.node_id, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS outs FROM nodes n LEFT JOIN edges ON src = n.node_id GROUP BY n.node_id),
changed AS (SELECT a.node_id FROM lists2 a LEFT JOIN lists1 b USING (node_id) WHERE b.outs IS NULL OR a.outs <> b.outs),
both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
h1 AS (SELECT node_id FROM changed UNION SELECT dst FROM both_ways JOIN changed ON src = node_id),
h2 AS (SELECT node_id FROM h1 UNION SELECT dst FROM both_ways JOIN h1 ON src = node_id),
h3 AS (SELECT node_id FROM h2 UNION SELECT dst FROM both_ways JOIN h2 ON src = node_id)"""
)


def rank_steps(k: int, spread: bool, p: str = "", edges: str = "edges", nodes: str = "nodes", start: str | None = None, active: str | None = None) -> str:
    """CTEs {p}r0 .. {p}rk of k iterations; start: SQL of the first ranks; active: table of nodes that move."""
    out = [
        f"{p}deg AS (SELECT src, count(*) AS d FROM {edges} GROUP BY src)",
        f"{p}nn AS (SELECT count(*)::DOUBLE AS c FROM {nodes})",
        f"{p}base AS (SELECT node_id, d IS NULL AS sink FROM {nodes} LEFT JOIN {p}deg ON src = node_id)",
        f"{p}r0 AS MATERIALIZED ({start or f'SELECT node_id, 1.0::DOUBLE / c AS r FROM {nodes}, {p}nn'})",
    ]
    for i in range(k):
        mass = f"(SELECT coalesce(sum(r), 0) FROM {p}r{i} JOIN {p}base USING (node_id) WHERE sink)" if spread else "0::DOUBLE"
        new = f"0.15::DOUBLE / c + 0.85::DOUBLE * (coalesce(s, 0) + {mass} / c)"
        frozen = f"CASE WHEN q.node_id IN (SELECT node_id FROM {active}) THEN {new} ELSE q.r END" if active else new
        out += [
            f"{p}i{i} AS (SELECT dst, sum(r / d) AS s FROM {edges} JOIN {p}deg USING (src) JOIN {p}r{i} ON node_id = src GROUP BY dst)",
            f"{p}r{i + 1} AS MATERIALIZED (SELECT q.node_id, {frozen} AS r FROM {p}r{i} q LEFT JOIN {p}i{i} ON dst = q.node_id, {p}nn)",
        ]
    return ",\n".join(out)


def rounded(ranks: DataFrame, digits: int = 10) -> DataFrame:
    return ranks.select("node_id", F.round("rank", digits).alias("rank"))


# Links and URLs ------------------------------------------------------------------------------------


@query(f"WITH {LINKS} SELECT link, count(DISTINCT page_id) AS n_pages FROM links GROUP BY link ORDER BY n_pages DESC, link LIMIT 20")
def top_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that most pages link to."""
    found = page_links(spark, sf_dir).select("page_id", "link").distinct()
    return found.groupBy("link").agg(F.count(F.lit(1)).alias("n_pages")).orderBy(F.desc("n_pages"), "link").limit(20)


@query(f"WITH {LINKS} SELECT page_id, pos, link FROM links")
def link_extract(spark, sf_dir):
    return page_links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


@query(f"WITH {LINKS} SELECT p.page_id, count(link) AS n_links FROM pages p LEFT JOIN links USING (page_id) GROUP BY p.page_id")
def links_per_page(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(links.crawlable_links(F.coalesce("html", F.lit("")))).cast("long").alias("n_links"))


KIND_SQL = "CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'absolute' WHEN starts_with(link, '//') THEN 'protocol' WHEN starts_with(link, '/') THEN 'root' ELSE 'relative' END"


@query(f"WITH {LINKS} SELECT {KIND_SQL} AS kind, count(*) AS n FROM links GROUP BY 1")
def link_kind_counts(spark, sf_dir):
    link = F.col("link")
    kind = F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "absolute").when(link.startswith("//"), "protocol").when(link.startswith("/"), "root").otherwise("relative")
    return page_links(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


DOMAIN_SQL = r"left(regexp_extract(url, '^(?:.*?://)?([^/]*)', 1), 255)"


@query(f"SELECT page_id, {DOMAIN_SQL} AS domain FROM pages")
def domain_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", policy.domain(F.col("url")).alias("domain"))


@query(f"SELECT lower({DOMAIN_SQL}) AS domain, count(*) AS n_pages FROM pages GROUP BY 1")
def pages_per_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.lower(policy.domain(F.col("url"))).alias("domain")).agg(F.count(F.lit(1)).alias("n_pages"))


@query(rf"""WITH {LINKS}, parts AS (SELECT page_id, pos, link, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) AS scheme, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root, regexp_replace(url, '[?#].*$', '') AS plain FROM links),
absolute AS (SELECT page_id, pos, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN scheme || link WHEN starts_with(link, '/') THEN root || link
  WHEN starts_with(link, '?') THEN plain || link WHEN plain = root THEN root || '/' || link ELSE regexp_replace(plain, '[^/]*$', '') || link END AS url FROM parts)
SELECT page_id, pos, url FROM absolute WHERE lower({DOMAIN_SQL}) IN (SELECT lower({DOMAIN_SQL}) FROM pages)""")
def same_domain_links(spark, sf_dir):
    """All links made absolute that lie on the domains of the crawled pages."""
    absolute = page_links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), links.resolve(F.col("url"), F.col("link")).alias("url"))
    return policy.on_seed_domains(absolute, table(spark, sf_dir, "pages").select("url"))


@query(f"WITH {LINKS}, all_urls AS (SELECT page_id * 1000 AS spot, url FROM pages UNION ALL SELECT page_id * 1000 + pos + 1, link FROM links) SELECT lower(url) AS url_key, arg_min(url, spot) AS url, count(*) AS n FROM all_urls GROUP BY lower(url)")
def url_dedup_ci(spark, sf_dir):
    """URLs that are the same but for case, in the spelling met first."""
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") * 1000).alias("at"), "url")
    found = page_links(spark, sf_dir).select((F.col("page_id") * 1000 + F.col("pos") + 1).alias("at"), F.col("link").alias("url"))
    return pages.unionByName(found).groupBy(policy.url_key(F.col("url")).alias("url_key")).agg(F.min_by("url", "at").alias("url"), F.count(F.lit(1)).alias("n"))


STATUS = [200, 301, 302, 303, 307, 308, 403, 404, 410, 429, 500, 503, 0, 418]
STATUS_SQL = "CASE WHEN code = 200 THEN 'OK' WHEN code IN (301, 302, 303, 307, 308) THEN 'REDIRECT' WHEN code = 403 THEN 'FORBIDDEN' WHEN code = 404 THEN 'NOT_FOUND' WHEN code = 410 THEN 'GONE' WHEN code = 429 OR code >= 500 THEN 'SERVER_ERROR' WHEN code = 0 THEN 'TIMEOUT' ELSE 'ERROR' END"


@query(f"WITH c AS (SELECT event_id, {STATUS}[(event_id % {len(STATUS)} + 1)::INT] AS code FROM events) SELECT event_id, code, {STATUS_SQL} AS outcome, CASE WHEN {STATUS_SQL} IN ('OK', 'REDIRECT') THEN 'DONE' ELSE 'FAILED' END AS state FROM c")
def http_outcome_map(spark, sf_dir):
    """Outcomes and states of made-up status codes."""
    code = F.get(F.array(*map(F.lit, STATUS)), (F.col("event_id") % len(STATUS)).cast("int"))
    out = table(spark, sf_dir, "events").select("event_id", code.alias("code")).withColumn("outcome", policy.outcome_of_status(F.col("code")))
    return out.withColumn("state", policy.state_after(F.col("outcome")))


# Crawls --------------------------------------------------------------------------------------------


@query(f"""WITH {LINKS}, seeds AS (SELECT lower(url) AS url_key, min(url) AS url, 0 AS depth FROM pages GROUP BY lower(url)),
found AS (SELECT DISTINCT lower(link) AS url_key, 1 AS depth FROM links WHERE lower(link) NOT IN (SELECT url_key FROM seeds))
SELECT url_key, depth, 'OK' AS outcome, 'DONE' AS state FROM seeds UNION ALL SELECT url_key, depth, 'NOT_FOUND', 'FAILED' FROM found""")
def crawl_frontier_d1(spark, sf_dir):
    """A crawl of one level from all pages."""
    pages = table(spark, sf_dir, "pages").select("url", "html")
    return crawl.crawl(pages.select("url"), pages, policy.CrawlPolicy(max_depth=1)).states.select("url_key", "depth", "outcome", "state")


def _user_pages(spark, sf_dir):
    """Users as pages that link to the next event's user: a graph with cycles."""
    lists = graph.adjacency(graph.observed_nodes(edges := event_graph(spark, sf_dir)), edges)
    html = F.array_join(F.transform("outlinks", lambda x: F.format_string('<a href="u%d">', x)), " ")
    return lists.select(F.concat(F.lit("u"), F.col("node_id").cast("string")).alias("url"), html.alias("html"))


@query(f"""WITH {EVENTS}, l1 AS (SELECT DISTINCT dst AS id FROM edges WHERE src = 0 AND dst <> 0),
l2 AS (SELECT DISTINCT dst AS id FROM edges JOIN l1 ON src = id WHERE dst <> 0 AND dst NOT IN (SELECT id FROM l1))
SELECT 'u0' AS url, 0 AS depth UNION ALL SELECT 'u' || id, 1 FROM l1 UNION ALL SELECT 'u' || id, 2 FROM l2""")
def crawl_levels(spark, sf_dir):
    """Two levels from one seed, each URL at its least depth."""
    seed = spark.createDataFrame([("u0",)], "url string")
    return crawl.crawl(seed, _user_pages(spark, sf_dir), policy.CrawlPolicy(max_depth=2, links_per_page=None)).states.select("url", "depth")


@query(f"""WITH {EVENTS}, l1 AS (SELECT 'u' || dst AS url, 1 AS depth, row_number() OVER (ORDER BY dst) AS seq FROM (SELECT DISTINCT dst FROM edges WHERE src = 0 AND dst <> 0))
SELECT 'u0' AS url, 0 AS depth, 0::BIGINT AS seq UNION ALL SELECT url, depth, seq FROM l1 WHERE seq < 25""")
def crawl_budget(spark, sf_dir):
    """A budget of 25 pages, spent in the order of the frontier."""
    seed = spark.createDataFrame([("u0",)], "url string")
    return crawl.crawl(seed, _user_pages(spark, sf_dir), policy.CrawlPolicy(max_depth=1, max_pages=25, links_per_page=None)).states.select("url", "depth", "seq")


# Graphs --------------------------------------------------------------------------------------------


@query(f"WITH {NODES} SELECT node_id, url, url_key FROM nodes")
def node_ids(spark, sf_dir):
    return graph.node_ids(url_links(spark, sf_dir))


@query(f"WITH {NODES} SELECT src, dst FROM edges")
def edge_distinct(spark, sf_dir):
    return web_graph(spark, sf_dir)[1]


@query(f"WITH {EVENTS} SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) GROUP BY src, dst")
def undirected_closure(spark, sf_dir):
    return graph.undirected(event_graph(spark, sf_dir)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {NODES}, d AS (SELECT node_id, count(dst) AS k FROM nodes LEFT JOIN edges ON src = node_id GROUP BY node_id)
SELECT count(*) AS n_nodes, sum(k)::BIGINT AS n_edges, count(*) FILTER (WHERE k = 0) AS n_dangling, max(k) AS max_out_degree, (SELECT count(*) FROM edges WHERE src = dst) AS n_self_loops FROM d""")
def graph_stats(spark, sf_dir):
    return graph.graph_stats(*web_graph(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT src AS node_id, count(*) AS out_degree FROM edges GROUP BY src")
def out_degree(spark, sf_dir):
    return graph.out_degree(order_graph(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT dst AS node_id, count(*) AS in_degree FROM edges GROUP BY dst")
def in_degree(spark, sf_dir):
    return graph.in_degree(order_graph(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT src FROM edges)")
def dangling_nodes(spark, sf_dir):
    edges = order_graph(spark, sf_dir)
    return graph.dangling_nodes(graph.observed_nodes(edges), edges)


@query(f"WITH {NODES} SELECT max(node_id) + 1 AS n FROM nodes")
def node_domain(spark, sf_dir):
    return web_graph(spark, sf_dir)[0].agg((F.max("node_id") + 1).alias("n"))


@query(f"""WITH {ORDERS}, d AS (SELECT node_id, count(dst) AS k FROM nodes LEFT JOIN edges ON src = node_id GROUP BY node_id)
SELECT node_id, coalesce(sum(k) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_start, sum(k) OVER (ORDER BY node_id)::BIGINT AS row_end FROM d""")
def csr_row_ptr(spark, sf_dir):
    edges = order_graph(spark, sf_dir)
    return graph.csr_row_ptr(graph.observed_nodes(edges), edges)


@query(f"WITH {NODES} SELECT node_id || ':' || coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS value FROM nodes LEFT JOIN edges ON src = node_id GROUP BY node_id")
def adjacency_build(spark, sf_dir):
    """Adjacency lists as lines of text."""
    return writers.adjacency_lines(graph.adjacency(*web_graph(spark, sf_dir)))


@query(f"WITH {NODES} SELECT src, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1)::BIGINT AS pos, dst FROM edges")
def adjacency_explode(spark, sf_dir):
    lists = graph.adjacency(*web_graph(spark, sf_dir))
    return graph.explode_adjacency(lists).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {EVENTS} SELECT node_id, coalesce(string_agg(src::VARCHAR, ',' ORDER BY src), '') AS inlinks FROM nodes LEFT JOIN edges ON dst = node_id GROUP BY node_id")
def reverse_adjacency(spark, sf_dir):
    edges = event_graph(spark, sf_dir)
    lists = graph.reverse_adjacency(graph.dense_nodes(edges, graph.node_count(edges)), edges)
    return lists.select("node_id", F.array_join(F.col("inlinks").cast("array<string>"), ",").alias("inlinks"))


@query(f"WITH {EVENTS}, o AS (SELECT max(node_id) + 1 AS k FROM nodes) SELECT src, dst FROM edges UNION ALL SELECT src + k, dst + k FROM edges, o")
def edges_union_offset(spark, sf_dir):
    """A graph and its copy behind it."""
    edges = event_graph(spark, sf_dir)
    return graph.union_graphs(edges, edges, graph.node_count(edges))


@query(f"WITH {EVENTS} SELECT src || ' ' || dst AS value FROM edges")
def edge_text(spark, sf_dir):
    return writers.edge_lines(event_graph(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT src, dst FROM edges")
def edge_text_round_trip(spark, sf_dir):
    """Edges written as text and read back."""
    path = frontier.shared_path(spark, "edges")
    writers.save_graph(event_graph(spark, sf_dir), path, "edgelist", ["edges"])
    return readers.read_edges(spark, path)


@query(f"WITH {NODES} SELECT src, dst FROM edges")
def adjacency_text_round_trip(spark, sf_dir):
    path = frontier.shared_path(spark, "lists")
    writers.save_graph(graph.adjacency(*web_graph(spark, sf_dir)), path, "adjacency", ["lists", ""])
    return readers.adjacency_edges(readers.read_adjacency(spark, path))


@query(f"WITH {NODES} SELECT l.page_id, n.node_id, count(*) AS n FROM links l LEFT JOIN nodes n ON n.url_key = lower(l.link) GROUP BY l.page_id, n.node_id")
def node_lookup(spark, sf_dir):
    """Ids of the links' URLs, whatever their letter case."""
    urls = page_links(spark, sf_dir).select("page_id", F.col("link").alias("url"))
    found = graph.lookup_ids(urls, graph.node_ids(url_links(spark, sf_dir)))
    return found.groupBy("page_id", "node_id").agg(F.count(F.lit(1)).alias("n"))


# Ranks ---------------------------------------------------------------------------------------------


@query(f"WITH {EVENTS}, {rank_steps(10, True)} SELECT node_id, round(r, 10) AS rank FROM r10")
def pagerank_fixed10(spark, sf_dir):
    return rounded(pagerank.run_preset("distributed_fixed", event_graph(spark, sf_dir), iterations=10).ranks)


@query(f"WITH {ORDERS}, {rank_steps(10, False)} SELECT node_id, round(r, 10) AS rank FROM r10")
def pagerank_drop10(spark, sf_dir):
    edges = order_graph(spark, sf_dir)
    return rounded(pagerank.pagerank(edges, nodes=graph.observed_nodes(edges), dangling="drop", max_iter=10).ranks)


@query(f"WITH {ORDERS}, {rank_steps(10, True)} SELECT node_id, round(r, 10) AS rank FROM r10")
def pagerank_go_dangling(spark, sf_dir):
    edges = order_graph(spark, sf_dir)
    return rounded(pagerank.pagerank(edges, nodes=graph.observed_nodes(edges), max_iter=10).ranks)


@query(f"WITH {EVENTS}, {rank_steps(8, True)} " + " UNION ALL ".join(f"SELECT {i + 1} AS iteration, round((SELECT sum(abs(b.r - a.r)) FROM r{i} a JOIN r{i + 1} b USING (node_id)), 9) AS delta" for i in range(8)))
def pagerank_delta_trace(spark, sf_dir):
    got = pagerank.pagerank(event_graph(spark, sf_dir), max_iter=8, tol=0.0)
    return spark.createDataFrame([(i + 1, d) for i, d in enumerate(got.deltas)], "iteration int, delta double").withColumn("delta", F.round("delta", 9))


@query(f"WITH {EVENTS}, {rank_steps(14, True)} SELECT node_id, round(r, 8) AS rank FROM r14")
def pagerank_converged(spark, sf_dir):
    """Ranks at rest; further iterations change no digit shown."""
    return rounded(pagerank.run_preset("distributed_convergence", event_graph(spark, sf_dir), threshold=1e-10).ranks, 8)


@query(f"WITH {NODES}, {rank_steps(10, True)} SELECT node_id, round(r, 8) AS rank FROM r10 ORDER BY round(r, 10) DESC, node_id LIMIT 10")
def rank_topk(spark, sf_dir):
    nodes, edges = web_graph(spark, sf_dir)
    ranks = pagerank.pagerank(edges, nodes=nodes.select("node_id"), max_iter=10).ranks
    return rounded(pagerank.top_k(rounded(ranks), 10), 8)


@query(f"WITH {EVENTS}, {rank_steps(6, True)} SELECT node_id, round(100 * r / (SELECT max(r) FROM r6), 6) AS pct FROM r6")
def rank_normalized(spark, sf_dir):
    ranks = pagerank.pagerank(event_graph(spark, sf_dir), max_iter=6).ranks
    return pagerank.normalized(ranks).select("node_id", F.round("pct", 6).alias("pct"))


@query(f"WITH {ORDERS}, {rank_steps(5, True)}, {rank_steps(5, False, 'd')} SELECT 'redistribute' AS dangling, round((SELECT sum(r) FROM r5), 9) AS mass UNION ALL SELECT 'drop', round((SELECT sum(r) FROM dr5), 9)")
def rank_mass(spark, sf_dir):
    edges = order_graph(spark, sf_dir)
    nodes = graph.observed_nodes(edges)
    out = [pagerank.pagerank(edges, nodes=nodes, dangling=d, max_iter=5).ranks.agg(F.round(F.sum("rank"), 9).alias("mass")).select(F.lit(d).alias("dangling"), "mass") for d in ("redistribute", "drop")]
    return out[0].unionAll(out[1])


@query(f"WITH {ORDERS}, {rank_steps(5, True)}, {rank_steps(5, False, 'd')} SELECT count(*) AS n, round(avg(abs(a.r - b.r)), 10) AS avg_diff, round(max(abs(a.r - b.r)), 10) AS max_diff FROM r5 a JOIN dr5 b USING (node_id)")
def rank_diff_stats(spark, sf_dir):
    edges = order_graph(spark, sf_dir)
    nodes = graph.observed_nodes(edges)
    a, b = (pagerank.pagerank(edges, nodes=nodes, dangling=d, max_iter=5).ranks for d in ("redistribute", "drop"))
    return incremental.rank_diff(a, b).select("n", F.round("avg_diff", 10).alias("avg_diff"), F.round("max_diff", 10).alias("max_diff"))



@query(f"WITH {EVENTS}, {rank_steps(6, True)} SELECT node_id, round(r, 9) AS rank FROM r6")
def rank_text_round_trip(spark, sf_dir):
    """Ranks written as a table of text and read back."""
    path = frontier.shared_path(spark, "ranks")
    writers.save_lines(writers.rank_table_lines(pagerank.pagerank(event_graph(spark, sf_dir), max_iter=6).ranks), path)
    return rounded(readers.read_ranks(spark, path), 9)


DELTAS = "deltas AS (" + " UNION ALL ".join(f"SELECT {i + 1} AS i, (SELECT sum(abs(b.r - a.r)) FROM r{i} a JOIN r{i + 1} b USING (node_id)) AS delta" for i in range(10)) + ")"


def _top_sql(steps: str) -> str:
    return f"(SELECT node_id FROM {steps} ORDER BY round(r, 12) DESC, node_id LIMIT 1)"


@query(f"""WITH {EVENTS}, {rank_steps(10, True)}, {DELTAS}, stop AS (SELECT min(i) AS k FROM deltas WHERE delta < 1e-4),
tops AS ({" UNION ALL ".join(f"SELECT {i} AS i, {_top_sql(f'r{i}')} AS top FROM nn" for i in range(1, 11))}),
s AS (SELECT name AS strategy, CASE WHEN ends_with(name, 'fixed') THEN 10 ELSE k END AS iterations FROM stop, (VALUES ('centralized_fixed'), ('centralized_convergence'), ('distributed_fixed'), ('distributed_convergence')) v(name))
SELECT strategy, iterations, top AS top_node, top = (SELECT top FROM tops WHERE i = 10) AS agrees FROM s JOIN tops ON i = iterations""")
def strategy_compare(spark, sf_dir):
    edges = event_graph(spark, sf_dir)
    got = compare.compare_strategies(edges, n=graph.node_count(edges), strategies=compare.FOUR)
    return got.select("strategy", "iterations", "top_node", "agrees")


# Growth --------------------------------------------------------------------------------------------


def _lists(spark, sf_dir):
    nodes, early, edges = two_phases(spark, sf_dir)
    return graph.adjacency(graph.observed_nodes(early), early), graph.adjacency(nodes, edges), early, edges


@query(f"WITH {PHASES} SELECT node_id FROM changed")
def affected_nodes(spark, sf_dir):
    old, new, _, _ = _lists(spark, sf_dir)
    return incremental.changed_nodes(old, new)


@query(f"WITH {PHASES} SELECT h3.node_id, CASE WHEN h3.node_id IN (SELECT node_id FROM changed) THEN 0 WHEN h3.node_id IN (SELECT node_id FROM h1) THEN 1 WHEN h3.node_id IN (SELECT node_id FROM h2) THEN 2 ELSE 3 END AS hop FROM h3")
def active_region_3hop(spark, sf_dir):
    old, new, _, edges = _lists(spark, sf_dir)
    return incremental.active_region(incremental.changed_nodes(old, new), edges)


OLD = rank_steps(10, True, "o", "edges1", "nodes1")
WARM = """SELECT node_id, coalesce(o.r * (1 - (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT node_id FROM nodes1)) * 0.15::DOUBLE / c) / (SELECT sum(r) FROM or10), 0.15::DOUBLE / c) AS r
FROM nodes LEFT JOIN or10 o USING (node_id), (SELECT count(*)::DOUBLE AS c FROM nodes)"""


@query(f"WITH {PHASES}, {OLD}, warm AS ({WARM}) SELECT node_id, round(r, 10) AS rank FROM warm")
def warm_start_ranks(spark, sf_dir):
    old, new, early, _ = _lists(spark, sf_dir)
    ranks = pagerank.pagerank(early, nodes=old.select("node_id"), max_iter=10).ranks
    return rounded(incremental.warm_start(ranks, new, new.count()))


@query(f"WITH {PHASES}, {OLD}, {rank_steps(5, True, 'n', start=WARM, active='h3')} SELECT node_id, round(r, 10) AS rank FROM nr5")
def pagerank_incremental_k(spark, sf_dir):
    old, new, early, edges = _lists(spark, sf_dir)
    ranks = pagerank.pagerank(early, nodes=old.select("node_id"), max_iter=10).ranks
    return rounded(incremental.incremental_pagerank(old, new, edges, ranks, tol=None, max_iter=5).ranking.ranks)


@query(f"WITH {PHASES}, {OLD}, {rank_steps(10, True, 'f')}, {rank_steps(10, True, 'n', start=WARM, active='h3')} SELECT count(*) AS n, round(avg(abs(a.r - b.r)), 8) AS avg_diff, round(max(abs(a.r - b.r)), 8) AS max_diff, (SELECT count(*) FROM changed) AS affected, (SELECT count(*) FROM h3) AS active FROM fr10 a JOIN nr10 b USING (node_id)")
def full_vs_incremental(spark, sf_dir):
    old, new, early, edges = _lists(spark, sf_dir)
    ranks = pagerank.pagerank(early, nodes=old.select("node_id"), max_iter=10).ranks
    got = incremental.compare_full_and_incremental(old, new, edges, ranks, tol=None, max_iter=10)
    return got.select("n", F.round("avg_diff", 8).alias("avg_diff"), F.round("max_diff", 8).alias("max_diff"), "affected", "active")


# Runs and streams ----------------------------------------------------------------------------------


def _seed_rows() -> str:
    return ", ".join(f"('{name}', [{', '.join(repr(u) for u in PROFILES[name])}])" for name in ("small", "large"))


@query(f"""WITH p(profile, urls) AS (VALUES {_seed_rows()}), c AS (SELECT profile, list_transform(string_split(array_to_string(urls, chr(10)) || chr(10), ''), lambda x: ascii(x)::HUGEINT) AS codes FROM p)
SELECT profile, list_reduce(list_prepend(1469598103934665603::HUGEINT, codes), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::VARCHAR AS hash FROM c""")
def manifest_hash(spark, sf_dir):
    """Hashes of the built-in seed lists."""
    rows = spark.createDataFrame([(k, list(PROFILES[k])) for k in ("small", "large")], "profile string, urls array<string>")
    return rows.select("profile", list_hash_of("urls").cast("string").alias("hash"))


def _page_stream(spark, sf_dir):
    """The pages as a stream of files."""
    schema = table(spark, sf_dir, "pages").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/pages.parquet*")


@query(f"WITH {LINKS} SELECT DISTINCT lower(link) AS url_key FROM links")
def stream_url_dedup(spark, sf_dir):
    """Links of a stream of pages, each URL once."""
    return frontier.drain(frontier.unseen(frontier.link_stream(_page_stream(spark, sf_dir)))).select("url_key")


@query(f"WITH {LINKS} SELECT lower(link) AS url_key, CASE WHEN bool_or(page_id % 3 = 2) THEN 'FAILED' ELSE 'DONE' END AS state, 3::BIGINT AS changes FROM links GROUP BY 1")
def stream_url_states(spark, sf_dir):
    """Where the URLs of a stream stand after they were pushed (as often as they are linked), popped and fetched; the page
    that links decides what the fetch comes to, and of several results the first in the alphabet."""
    pages = _page_stream(spark, sf_dir).withColumn("result", F.element_at(F.array(F.lit("OK"), F.lit("REDIRECT"), F.lit("FAIL")), (F.col("page_id") % 3 + 1).cast("int")))
    found = pages.select(F.explode(links.crawlable_links(F.coalesce("html", F.lit("")))).alias("url"), "result")
    events = found.select("url", F.posexplode(F.array(F.lit("PUSH"), F.lit("POP"), F.col("result"))).alias("at", "event"))
    latest = frontier.drain(frontier.url_states(events), "update")
    return latest.groupBy("url_key").agg(F.max_by(F.struct("state", "changes"), "batch").alias("s")).select("url_key", "s.state", "s.changes")


@query("SELECT page_id FROM pages WHERE page_id < (SELECT floor((max(page_id) + 1) * (1 - 0.02::DOUBLE)) FROM pages)")
def first_phase(spark, sf_dir):
    return first_phase_pages(table(spark, sf_dir, "pages")).select("page_id")
