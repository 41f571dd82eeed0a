"""PageRank in one operator; the presets are its strategies by name.

Edge weights 1/out-degree are worked out once and kept partitioned and sorted by source, together with a row
for each node that leads to itself. So an iteration is one join without a shuffle and one pre-aggregated
shuffle of contributions, in which the rows of nodes carry what is to be kept; it refers to the ranks once,
and several iterations make one plan and one job.

What a node gets beside its inflow (teleport and spread dangling rank) is the same scalar c for all that
move, and an iteration is affine: with y(j+1) = d A y(j) and z(j+1) = d A z(j), from the ranks at the
beginning and from ones, ranks after j iterations are ``y(j) + sum_i c(j-1-i) z(i)``. So a block of
iterations runs without knowing its scalars; one aggregate over the vectors yields the dangling mass of
every iteration of the block, hence all c, and another one all changes. z is worked out in the first block
only, and from uniform ranks y is a multiple of it. One checkpoint ends a block. A source with very many
edges is dealt to several tasks, each with a copy of its rank.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.lineage import cut, planned_once
from linkloom.operators.graph import dense_nodes, node_count

DAMPING = 0.85
MAX_ITERATIONS = 100
BLOCK = 10  # iterations of a block; half as many where each one's change is wanted
HUB_EDGES = 1 << 20  # out of one node that one task takes


@dataclass
class Ranking:
    """ranks (node_id, rank), how many iterations it took, and the change of each that was measured."""

    ranks: DataFrame
    iterations: int
    deltas: list[float] = field(default_factory=list)
    converged: bool = False


def weighted(edges: DataFrame, nodes: DataFrame, hub_edges: int = HUB_EDGES, feeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows (src, slot, dst, w) by source: the edges (of feeds, all count for the weights) and, without a weight, each node to
    itself; and the hubs (src, slots), if any, whose edges are dealt to slots."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    out = (edges if feeds is None else feeds).join(degree, "src").select("src", F.lit(0).alias("slot"), "dst", (1.0 / F.col("deg")).alias("w"))
    own = nodes.select(F.col("node_id").alias("src"), F.lit(0).alias("slot"), F.col("node_id").alias("dst"), F.lit(None).cast("double").alias("w"))
    hubs = degree.filter(F.col("deg") > hub_edges).select("src", F.ceil(F.col("deg") / hub_edges).cast("int").alias("slots"))
    if hubs.isEmpty():
        return out.unionByName(own).repartition(parts, "src").sortWithinPartitions("src"), None
    hubs = cut(hubs)
    out = out.drop("slot").join(hubs, "src", "left").withColumn("slot", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("slots")).cast("int"), F.lit(0)))
    return out.select("src", "slot", "dst", "w").unionByName(own).repartition(parts, "src", "slot").sortWithinPartitions("src", "slot"), hubs


def _step(links: DataFrame, hubs: DataFrame | None, state: DataFrame, kept: list[str], chains: dict[str, str], damping: float, extra: float = 0.0) -> DataFrame:
    """state with the next column of each chain (new: from), extra and the damped inflow; of the others only those to be kept stay."""
    ranks = state.withColumnRenamed("node_id", "src")
    on = ["src"]
    if hubs is not None:
        slots = F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)
        ranks, on = ranks.join(hubs, "src", "left").withColumn("slot", F.explode(slots)).drop("slots"), ["src", "slot"]
    own = F.col("w").isNull()
    needed = list(dict.fromkeys([*kept, *chains.values()]))
    met = links.hint("merge").join(ranks, on).select(F.col("dst").alias("node_id"), *(F.when(~own, F.col("w") * F.col(c)).alias(f"{new} in") for new, c in chains.items()), *(F.when(own, F.col(c)).alias(c) for c in needed))
    wide = met.groupBy("node_id").agg(*(F.sum(f"{new} in").alias(f"{new} in") for new in chains), *(F.max(c).alias(c) for c in needed))
    moved = {new: extra + damping * F.coalesce(F.col(f"{new} in"), F.lit(0.0)) for new in chains}
    if "moves" in kept:
        moved = {new: F.when(F.col("moves"), x).otherwise(F.col(chains[new]) if new[0] == "y" else F.lit(0.0)) for new, x in moved.items()}
    return wide.select("node_id", *kept, *(x.alias(new) for new, x in moved.items()))


def pagerank(
    edges: DataFrame,
    *,
    n: int | None = None,
    nodes: DataFrame | None = None,
    damping: float = DAMPING,
    dangling: str = "redistribute",
    max_iter: int = MAX_ITERATIONS,
    tol: float | None = None,
    min_iter: int = 1,
    init: DataFrame | None = None,
    active: DataFrame | None = None,
    hub_edges: int = HUB_EDGES,
) -> Ranking:
    """Rank nodes by their in-links; repeated edges count as often as they occur.

    nodes (node_id) are ranked, or 0..n-1, n being one more than the largest id. dangling: the rank of
    nodes without edges is spread over all ("redistribute") or lost ("drop"). tol: stop once the summed
    absolute change of an iteration is below it. init (node_id, rank): where to start. active (node_id):
    only these nodes change; the others keep their rank but still give it on.
    """
    if dangling not in ("redistribute", "drop"):
        raise ValueError(f"unknown treatment of dangling nodes: {dangling}")
    edges = edges.select("src", "dst").persist(StorageLevel.MEMORY_AND_DISK)
    if nodes is None:
        n = node_count(edges) if n is None else n
        nodes = dense_nodes(edges, n)
    else:
        nodes = nodes.select("node_id").persist(StorageLevel.MEMORY_AND_DISK)
        n = nodes.count() if n is None else n
    if not n:
        edges.unpersist()
        return Ranking(nodes.select("node_id", F.lit(0.0).alias("rank")), 0)
    teleport = (1 - damping) / n
    links = edges.select("src", "dst").join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    uniform = init is None and active is None
    feeds = None if active is None else links.join(active.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    out, hubs = weighted(links, nodes, hub_edges, feeds)
    with planned_once(edges.sparkSession):  # a plan that may change would hide how its rows are dealt and sorted
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
    spreads = dangling == "redistribute"
    state = nodes.select("node_id", F.lit(1.0).alias("z0"))
    flags = []
    if spreads:
        sources = links.select(F.col("src").alias("node_id"), F.lit(False).alias("sink")).distinct()
        state, flags = state.join(sources, "node_id", "left").fillna(True, ["sink"]), ["sink"]
    if not uniform:
        state = state.withColumn("y0", F.lit(1.0 / n)) if init is None else state.join(init.select("node_id", F.col("rank").alias("y0")), "node_id", "left").fillna(teleport, ["y0"])
    if active is not None:
        state = state.join(active.select("node_id", F.lit(True).alias("moves")), "node_id", "left").fillna(False, ["moves"]).withColumn("z0", F.when(F.col("moves"), 1.0).otherwise(0.0))
        flags.append("moves")
    try:
        state = cut(state)
        if tol is None and not (spreads and state.filter("sink").limit(1).count()):
            return _steady(out, hubs, state.withColumn("y0", F.lit(1.0 / n)) if uniform else state, [f for f in flags if f == "moves"], damping, teleport, max_iter)
        return _blocks(out, hubs, state, flags, uniform, n, damping, teleport, spreads, max_iter, tol, min_iter)
    finally:
        for spent in (out, edges, nodes):
            spent.unpersist()


def _steady(out: DataFrame, hubs: DataFrame | None, state: DataFrame, flags: list[str], damping: float, teleport: float, max_iter: int) -> Ranking:
    """Iterations of which no scalar is wanted: only the ranks themselves are carried along."""
    state = state.select("node_id", *flags, "y0")
    for j in range(1, max_iter + 1):
        state = _step(out, hubs, state, flags, {"y1": "y0"}, damping, teleport).withColumnRenamed("y1", "y0")
        if j % BLOCK == 0 or j == max_iter:
            with planned_once(out.sparkSession):
                state = cut(state, as_it_is=True)
    return Ranking(state.select("node_id", F.col("y0").alias("rank")), max_iter, [], False)


def _blocks(out: DataFrame, hubs: DataFrame | None, state: DataFrame, flags: list[str], uniform: bool, n: int, damping: float, teleport: float, spreads: bool, max_iter: int, tol: float | None, min_iter: int) -> Ranking:
    size = BLOCK if tol is None else BLOCK // 2
    ones: DataFrame | None = None  # z(0) to z(size - 1) by node, from the first block
    ones_mass: list[float] = []
    deltas: list[float] = []
    done = 0
    ranks = state.select("node_id", F.lit(1.0 / n).alias("rank")) if uniform else state.select("node_id", F.col("y0").alias("rank"))
    while done < max_iter:
        m = min(size, max_iter - done)
        first, plain = ones is None, ones is None and uniform  # plain: y(j) is z(j)/n
        for j in range(m):
            chains = ({} if plain else {f"y{j + 1}": f"y{j}"}) | ({f"z{j + 1}": f"z{j}"} if first else {})
            names = [*flags, *([] if plain else [f"y{i}" for i in range(j + 1)]), *([f"z{i}" for i in range(j + 1)] if first else [])]
            state = _step(out, hubs, state, names, chains, damping)
        with planned_once(out.sparkSession):
            wide = cut(state if first else state.join(ones, "node_id"), as_it_is=True)
        y = [F.col(f"z{j}") / n if plain else F.col(f"y{j}") for j in range(m + 1)]
        if first:
            ones = wide.select("node_id", *(f"z{i}" for i in range(m)))
        shared: list[float] = []  # c of each iteration
        if spreads:
            names = [f"y{j}" for j in range(m)] * (not plain) + [f"z{i}" for i in range(m)] * first
            got = wide.filter("sink").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names)).first()
            ones_mass = [got[f"z{i}"] for i in range(m)] if first else ones_mass
            for j in range(m):
                mass = ones_mass[j] / n if plain else got[f"y{j}"]
                mass += sum(shared[j - 1 - i] * ones_mass[i] for i in range(j))
                shared.append(teleport + damping * mass / n)
        else:
            shared = [teleport] * m

        def ranks_after(j: int) -> Column:
            total = y[j]  # noqa: B023
            for i in range(j):
                total = total + shared[j - 1 - i] * F.col(f"z{i}")  # noqa: B023
            return total

        if tol is not None:
            wide = cut(wide.select("node_id", *flags, *(ranks_after(j).alias(f"x{j}") for j in range(m + 1))))
            changes = wide.agg(*(F.coalesce(F.sum(F.abs(F.col(f"x{j + 1}") - F.col(f"x{j}"))), F.lit(0.0)).alias(f"d{j}") for j in range(m))).first()
            for j in range(m):
                deltas.append(changes[j])
                if changes[j] < tol and done + j + 1 >= min_iter:
                    return Ranking(wide.select("node_id", F.col(f"x{j + 1}").alias("rank")), done + j + 1, deltas, True)
            now = F.col(f"x{m}")
        else:
            now = ranks_after(m)
        done += m
        ranks = wide.select("node_id", now.alias("rank"))
        state = wide.select("node_id", *flags, now.alias("y0"))
    return Ranking(ranks, done, deltas, False)


#: The named strategies. Where work happens (threads, locks, buffers) is Spark's business and has no
#: meaning of its own here, so centralized and distributed differ in name only.
PRESETS: dict[str, dict] = {
    "sequential": {"tol": 1e-8},
    "parallel": {"tol": 1e-8},
    "centralized_fixed": {},
    "centralized_convergence": {},
    "distributed_fixed": {},
    "distributed_convergence": {},
    "leaky": {"dangling": "drop", "tol": 1e-10, "max_iter": 1_000_000},
    "incremental_full": {"dangling": "drop", "tol": 1e-10, "max_iter": 1_000_000},
    "csr_fixed": {"max_iter": 50},
    "csr_convergence": {"max_iter": 50, "tol": 1e-6, "min_iter": 2},
}


def run_preset(name: str, edges: DataFrame, *, iterations: int | None = None, threshold: float | None = None, **options) -> Ranking:
    """A strategy by name; the fixed ones take iterations, the converging ones a threshold."""
    settings = PRESETS[name] | options
    if iterations is not None:
        settings["max_iter"] = iterations
    if threshold is not None and not name.endswith("_fixed"):
        settings["tol"] = threshold
    return pagerank(edges, **settings)


def top_k(ranks: DataFrame, k: int = 5) -> DataFrame:
    """The k highest ranks; ties go to the smaller id."""
    return ranks.orderBy(F.desc("rank"), F.asc("node_id")).limit(k)


def normalized(ranks: DataFrame) -> DataFrame:
    """ranks with pct, the share of the highest rank in percent."""
    top = ranks.agg(F.max("rank").alias("_top"))
    return ranks.crossJoin(F.broadcast(top)).withColumn("pct", 100 * F.col("rank") / F.col("_top")).drop("_top")
