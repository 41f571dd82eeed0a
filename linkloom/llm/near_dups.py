"""Operator 9: near-duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its distinct 5-word shingles, 64-bit hashes of lower-case words. Documents with
equal sets (by 128 bits) become one node at once. Each node has a fast similarity sketch of 120
coordinates; nodes that agree in a band of neighbouring coordinates share a bucket. Bands are as long as
the threshold allows: five coordinates at 85 percent, four at 80 (a pair at the threshold misses all bands
with a probability below 1e-6). Every link is confirmed on the full sets; sketches only name candidates.

No pair of a bucket is written as a row. First every member meets its bucket's leader, the member that
shares buckets with most others; that joins a group of copies in one round. Buckets that still hold
several components are compared inside tasks, in blocks with their sets, by products of incidence
matrices, and a task hands on only links that join components. In a bucket of more than one block a
member goes first if no partner there can have enough of it: its shingles that any other member has, and
the sizes in the bucket, bound every similarity from above, so this loses no link. It removes copies
with too many edits of their own, which are most of what a large group of loose copies holds. Components are
found by alternating stars.

Defined cases: a text without words has an empty set and is linked with nothing; repeated rows are linked
with each other; component_id is the smallest non-null doc_id of the component, null if it has none, and
kept compares null-safely; of equally good leaders the greatest key leads, which changes no result; long
texts are hashed in pieces; other columns are ignored (near_duplicates) or kept as they are, whatever
their names (keep_one_each); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import batches, cut, drop_rows, in_bitmap, keep_rows, key_bitmap, lean, plain, release, row_keys, table
from linkloom.llm.components import components
from linkloom.llm.packing import _portions
from linkloom.llm.shingles import COORDINATES, band_keys, fingerprint, shingle_sets, sketch

MIN_PERCENT = 85
STAGE_PERCENT = 80  # of the pipeline's stage
MISSED = 1e-6  # probability that a pair at the threshold shares no band
BLOCK = 512  # members of a bucket that are compared in one go
BLOCK_SHINGLES = 1 << 18  # and their shingles, about
COLUMNS = 4096  # of the incidence matrices at a time


def band_count(min_percent: int) -> int:
    """The fewest bands, of equal length, all of which a pair at the threshold misses with a probability below MISSED."""
    whole = [n for n in range(1, COORDINATES + 1) if COORDINATES % n == 0]
    return next((n for n in whole if (1 - (min_percent / 100) ** (COORDINATES // n)) ** n < MISSED), COORDINATES)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows' other columns and shingle sets, portion by portion; text is the first column."""
    texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
    rest = [c.to_pylist() for c in batch.columns[1:]]
    for a, b in _portions(texts, 1 << 19):
        yield [c[a:b] for c in rest], shingle_sets(texts[a:b])


class Seen:
    """Which keys a task has met; forgets all now and then, which only costs sending some again."""

    def __init__(self, most: int = 300_000):
        self.keys: set = set()
        self.most = most

    def new(self, key) -> bool:
        if len(self.keys) >= self.most:
            self.keys.clear()
        before = len(self.keys)
        self.keys.add(key)
        return len(self.keys) > before


def sketched(docs: DataFrame, bands: int) -> DataFrame:
    """doc_id, _k1, _k2 of each row, n_shingles, node (the set's fingerprint) and keys, one for each band; a task gives keys once for a node."""
    schema = pa.schema([("doc_id", pa.int64()), ("_k1", pa.int64()), ("_k2", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen = Seen()
        for batch in it:
            for rest, sets in _texts(batch):
                for doc_id, k1, k2, s in zip(*rest, sets, strict=True):
                    node = fingerprint(s) if len(s) else None
                    yield doc_id, k1, k2, len(s), node, band_keys(sketch(s), bands) if node and seen.new(node) else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(it), schema)

    return row_keys(docs).select("text", "doc_id", "_k1", "_k2").mapInArrow(lean(run), "doc_id long, _k1 long, _k2 long, n_shingles long, node binary, keys array<long>")


def sets_of(docs: DataFrame, base: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles (sorted 64-bit hashes as bytes) for the nodes of a table. One document of each node is
    read again; a bitmap of their row keys tells the scan which texts to hash."""
    chosen = cut(base.groupBy("node").agg(F.min("_k1").alias("_k1")).join(nodes, "node"))
    sent = key_bitmap(chosen, "_k1")
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.binary())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bitmap, seen = sent.value, Seen()
        for batch in it:
            wanted = batch.filter(pa.array(in_bitmap(bitmap, batch.column("_k1").to_numpy())))
            for _, sets in _texts(wanted):
                for s in sets:
                    if len(s) and seen.new(node := fingerprint(s)):
                        yield node, s.tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(it), schema, 2048, 1 << 20)

    found = row_keys(docs).select("text", "_k1").mapInArrow(lean(run), "node binary, shingles binary")
    return found.join(chosen.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _groups(it: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows that agree in their first columns, which stand together."""
    group: list[tuple] = []
    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[:width] != group[0][:width]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def with_leaders(docs: DataFrame, base: DataFrame, members: DataFrame, min_percent: int) -> DataFrame:
    """Links (a, b) between members of buckets and their leaders, confirmed on full sets."""
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    leaders = cut(members.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node", "size")).alias("top")).select("key", F.col("top.node").alias("leader"), F.col("top.size").alias("of")))
    pairs = members.join(leaders, "key").filter("node <> leader").filter(F.least("size", "of") * 100 >= F.greatest("size", "of") * min_percent)
    pairs = pairs.groupBy("node", "leader").agg(F.max("n").alias("n"))
    # A leader of many meets them in several tasks.
    pairs = cut(pairs.select("leader", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).alias("salt"), "node"))
    sets = cut(sets_of(docs, base, pairs.select("node").union(pairs.select("leader")).distinct()))
    heads = pairs.select("leader", "salt", F.col("leader").alias("node"), F.lit(False).alias("member")).distinct()
    rows = heads.unionByName(pairs.withColumn("member", F.lit(True))).join(sets, "node").select("leader", "salt", "member", "node", "shingles")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = head = None
        for batch in it:
            good = []
            for lead, _, member, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(data, np.uint64)
                if not member:
                    leader, head = lead, own
                    good.append(False)
                    continue
                assert leader == lead
                both = int((head[np.minimum(np.searchsorted(head, own), len(head) - 1)] == own).sum())
                good.append(100 * both >= min_percent * (len(head) + len(own) - both))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.record_batch([kept.column("leader"), kept.column("node")], names=["a", "b"])

    order = ["leader", "salt"]
    links = cut(rows.repartition(*order).sortWithinPartitions(*order, "member").mapInArrow(lean(run), "a binary, b binary"))
    release(sets, pairs, leaders)
    return links


def supported(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """node, support for the hot nodes: at least as many as there are shingles of the node in any other hot node's set."""
    own = sets.join(hot, "node", "left_semi")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                shingle, n = np.unique(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64), return_counts=True)
                yield pa.record_batch([pa.array(shingle), pa.array(n)], names=["shingle", "n"])

    common = cut(own.mapInArrow(lean(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter("n > 1").select("shingle"))
    sent = key_bitmap(common, "shingle")
    release(common)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            support = [int(in_bitmap(sent.value, np.frombuffer(x, np.int64)).sum()) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0).cast(pa.binary()), pa.array(support, pa.int64())], names=["node", "support"])

    return own.mapInArrow(lean(run), "node binary, support long")


def links_between(left: list[tuple], right: list[tuple] | None, min_percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links of similar enough sets that join the components of rows (label, node, shingles); among left if there is no right."""
    rows = left if right is None else left + right
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    component = {label: k for k, label in enumerate(dict.fromkeys(r[0] for r in rows))}
    of = np.array([component[r[0]] for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    split = len(left)
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # whole numbers up to there are exact
    both = np.zeros((split, len(rows) - split if right is not None else split), kind)
    width = int(column[-1]) + 1 if len(column) else 0
    edges = np.searchsorted(column, range(0, width + COLUMNS, COLUMNS))
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        matrix = np.zeros((len(rows), min(COLUMNS, width - k * COLUMNS)), kind)
        matrix[owner[a:b], column[a:b] - k * COLUMNS] = 1
        both += matrix[:split] @ (matrix[split:] if right is not None else matrix).T
    other = slice(split, None) if right is not None else slice(None)
    union = sizes[:split, None] + sizes[None, other] - both
    i, j = np.nonzero((100 * both >= min_percent * union) & (of[:split, None] != of[None, other]))
    if right is not None:
        j = j + split
    _, first = np.unique(of[i] * len(component) + of[j], return_index=True)
    group = list(range(len(component)))

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for k in first.tolist():
        p, q = root(of[i[k]]), root(of[j[k]])
        if p != q:
            group[p] = q
            yield rows[i[k]][1], rows[j[k]][1]


def within_buckets(docs: DataFrame, base: DataFrame, members: DataFrame, labels: DataFrame, min_percent: int) -> DataFrame | None:
    """Links (a, b) that join components which share a bucket; None if no bucket holds several."""
    labelled = cut(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    each = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("size").alias("least"), F.min("label").alias("l0"), F.max("label").alias("l1")]
    own = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    mixed = labelled.groupBy("key").agg(*each, *own).filter("l0 <> l1")
    mixed = cut(mixed.groupBy("n", "total", "least", "x", "y").agg(F.min("key").alias("key")).drop("x", "y"))  # buckets of the same members once
    most = mixed.agg(F.max("n")).first()[0]
    if most is None:
        release(labelled, mixed)
        return None
    rows = labelled.drop("n").join(mixed, "key")
    nodes = cut(rows.groupBy("node").agg(F.max("n").alias("n")))
    sets = cut(sets_of(docs, base, nodes.select("node")))
    if most > BLOCK:
        support = supported(sets, nodes.filter(F.col("n") > BLOCK).select("node"))
        # A partner has min_percent of the size at least, and no smaller size than any in the bucket.
        partner = F.greatest("least", F.ceil(F.col("size") * min_percent / 100))
        able = F.col("support") * (100 + min_percent) >= min_percent * (F.col("size") + partner)
        hot = rows.filter(F.col("n") > BLOCK).join(support, "node").filter(able).select("key", "node", "label", "size")
        counts = cut(hot.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").drop("l0", "l1"))
        names = ["key", "node", "label", "n", "total"]
        rows = rows.filter(F.col("n") <= BLOCK).select(*names).unionByName(hot.join(counts, "key").select(*names))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    order = ["key", "i", "j"]
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "label", "node").join(sets, "node")
    rows = rows.select(*order, "block", "label", "node", "shingles").repartition(*order).sortWithinPartitions(*order, "block")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        for group in _groups(it, 3):
            _, i, j = group[0][:3]
            left = [r[4:] for r in group if r[3] == i]
            right = [r[4:] for r in group if r[3] == j] if i < j else None
            if len(left) + len(right or ()) > 1 and left and right != []:
                yield from links_between(left, right, min_percent)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(found(it), schema)

    links = cut(rows.mapInArrow(lean(run), "a binary, b binary"))
    release(labelled, mixed, nodes, sets)
    return links


def linked(docs: DataFrame, min_percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and node, label of the nodes that are linked with others: rows with equal labels are one group."""
    base = cut(sketched(docs, band_count(min_percent)))
    nodes = base.filter("keys is not null").select("node", F.col("n_shingles").alias("size"), "keys").dropDuplicates(["node"])
    keys = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = cut(keys.join(shared, "key").select("key", "node", "size", "n"))
    release(shared)
    links = with_leaders(docs, base, members, min_percent)
    labels = cut(components(links))
    more = within_buckets(docs, base, members, labels, min_percent)
    if more is not None:
        release(links)
        first, labels = labels, cut(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(more)))
        release(first, more)
    release(members)
    return base, labels


def near_duplicates(docs: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept, and the row's _k1 and _k2."""
    base, labels = linked(plain(docs, "doc_id", "source", "text"), min_percent)
    own = base.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = cut(own.groupBy("label").agg(F.min("least").alias("component_id")))
    of = cut(own.select("node", "label").join(least, "label").select("node", "component_id"))
    out = base.select("doc_id", "n_shingles", "_k1", "_k2", "node").join(of, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "_k1", "_k2")


def keep_one_each(docs: DataFrame, min_percent: int = STAGE_PERCENT) -> DataFrame:
    """docs with exactly one row of each group of near-duplicates: of the smallest doc_id that is not null, then of the
    smallest row key, then any of equal rows. Texts without words are in no group and stay."""
    names, docs = docs.columns, plain(docs, "doc_id", "source", "text")
    base, labels = linked(docs, min_percent)
    linkable = base.filter("n_shingles > 0")
    first = linkable.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k1", "_k2")).alias("row"))
    heads = first.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("row").alias("row"))
    heads = heads.select("row._k1", "row._k2", F.lit(True).alias("head"))
    rows = linkable.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n")).join(heads, ["_k1", "_k2"], "left")
    gone = cut(rows.filter("head IS NULL OR n > 1").select("_k1", "_k2", "head"))
    out = drop_rows(docs, gone.select("_k1", "_k2"))
    again = gone.filter("head").select("_k1", "_k2")  # rows that stay once
    if again.isEmpty():
        return out.toDF(*names)
    return out.unionByName(keep_rows(docs, again).dropDuplicates(["_k1", "_k2"]).select(*docs.columns)).toDF(*names)


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op9_near_dups": op9_near_dups}

SQL = {
    "op9_near_dups": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= {MIN_PERCENT} * (p.c + q.c - k)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, m.y FROM reach r JOIN sym m ON m.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT c.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""
}
