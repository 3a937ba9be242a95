"""Internal link graph, anchors, revenue; connected components, PageRank, betweenness."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.dims import GENERIC_ANCHORS
from lodestar.plans.dialect import Duck, operator, text
from lodestar.sources.shipping import ship


def link_key(d: Duck, url: str) -> str:
    """Lower case without query, fragment and trailing slash; a bare host or an empty url gets "/"."""
    cut = d.sub(d.sub(f"lower(trim({url}))", "[?#].*$", ""), "/+$", "")
    return f"CASE WHEN {cut} = '' OR {d.like(cut, '^[a-z][a-z0-9+.-]*://[^/]+$')} THEN {cut} || '/' ELSE {cut} END"


@operator
def build_edges(d: Duck) -> str:
    """D1. Weighted edges of ``links`` (source, target, type): hyperlinks, without self links."""
    return f"""
SELECT src, dst, CAST(count(*) AS BIGINT) AS weight FROM (SELECT {link_key(d, 'source')} AS src, {link_key(d, 'target')} AS dst FROM @links@
  WHERE type = '' OR lower(type) LIKE '%hyperlink%' OR lower(type) LIKE '%ahref%') AS l WHERE src <> dst GROUP BY src, dst"""


@operator
def degrees(d: Duck) -> str:
    """D2. Distinct neighbours of every node of ``edges`` (src, dst)."""
    return """
SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (
  SELECT dst AS node, 1 AS i, 0 AS o FROM @edges@ UNION ALL SELECT src AS node, 0 AS i, 1 AS o FROM @edges@) AS u GROUP BY node"""


@operator
def node_classes(d: Duck) -> str:
    """D5, D6. Classes of ``nodes`` (node, in_degree, out_degree, pagerank, betweenness) against 75th percentiles by position."""
    sort = lambda c: f"max(CASE WHEN rn_{c} = k THEN {c} END) OVER () AS p_{c}"
    columns = ("in_degree", "out_degree", "pagerank", "betweenness")
    ranks = ", ".join(f"row_number() OVER (ORDER BY {c}, node) AS rn_{c}" for c in columns)
    return f"""
SELECT node, in_degree = 0 AS orphan, out_degree = 0 AS dead_end, out_degree >= p_out_degree AND out_degree > 5 AS hub,
  in_degree >= p_in_degree AND pagerank >= p_pagerank AS authority, betweenness >= p_betweenness AND betweenness > 1e-3 AS bridge
FROM (SELECT *, {", ".join(map(sort, columns))} FROM (
  SELECT *, {d.int('count(*) OVER () * 75e-2')} + 1 AS k, {ranks} FROM @nodes@) AS r) AS t"""


def classify_nodes(nodes: DataFrame) -> DataFrame:
    """D5, D6 by order statistics: rows as of ``node_classes``, without a global window."""
    from lodestar.operators.order import value_at

    n = nodes.count()
    least = {c: value_at(nodes, c, int(n * 0.75) + 1) for c in ("in_degree", "out_degree", "pagerank", "betweenness")}
    over = lambda c: F.col(c) >= F.lit(least[c])
    return nodes.select(
        "node", (F.col("in_degree") == 0).alias("orphan"), (F.col("out_degree") == 0).alias("dead_end"), (over("out_degree") & (F.col("out_degree") > 5)).alias("hub"),
        (over("in_degree") & over("pagerank")).alias("authority"), (over("betweenness") & (F.col("betweenness") > 1e-3)).alias("bridge"),
    )


@operator
def graph_summary(d: Duck) -> str:
    """D7. Totals over ``edges`` and ``degrees``."""
    return """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM @edges@) AS edges, CAST(count(*) AS BIGINT) AS nodes, round(avg(in_degree), 4) AS avg_in, round(avg(out_degree), 4) AS avg_out,
  CAST(count_if(in_degree = 0) AS BIGINT) AS orphans, CAST(count_if(out_degree = 0) AS BIGINT) AS dead_ends FROM @degrees@"""


def top_list(name: str, table: str, where: str, by: str, top: int, key: str) -> str:
    """Ranked rows (list, rank, ``key``, value) of the first ``top`` by an order; only those are numbered."""
    value = by.removesuffix(" DESC")
    return f"""SELECT '{name}' AS list, CAST(row_number() OVER (ORDER BY {by}, {key}) AS BIGINT) AS rank, {key}, CAST({value} AS DOUBLE) AS value FROM (
  SELECT {key}, {value} FROM {table} WHERE {where} ORDER BY {by}, {key} LIMIT {top}) AS t_{name}"""


@operator
def graph_lists(d: Duck, min_links: int = 0) -> str:
    """D7. Top lists of ``nodes`` (node, in_degree, out_degree, pagerank, betweenness) by their ``classes``.

    ``min_links`` concerns the first list alone: either degree reaches it, or the page is an orphan.
    """
    lists = [
        ("top_pages", f"in_degree >= {min_links} OR out_degree >= {min_links} OR orphan", "pagerank DESC", 30), ("orphans", "orphan", "pagerank DESC", 50), ("hubs", "hub", "out_degree DESC", 20),
        ("authorities", "authority", "pagerank DESC", 20), ("bridges", "bridge", "betweenness DESC", 20), ("dead_ends", "dead_end", "pagerank DESC", 30),
    ]
    parts = " UNION ALL ".join(top_list(name, "rated", where, by, top, "node") for name, where, by, top in lists)
    return f"""
WITH rated AS (SELECT n.*, c.orphan, c.dead_end, c.hub, c.authority, c.bridge FROM @nodes@ n JOIN @classes@ c ON n.node = c.node)
{parts}"""


def lists_of_graph(nodes: DataFrame, min_links: int = 0) -> DataFrame:
    """D7. ``graph_lists`` of ``nodes`` and their ``classify_nodes``, both made once for all lists."""
    nodes = settled(nodes)
    return graph_lists(nodes=nodes, classes=settled(classify_nodes(nodes)), min_links=min_links)


_GENERIC = ", ".join(text(a) for a in GENERIC_ANCHORS)


def anchors_of(d: Duck) -> str:
    return f"""(SELECT {link_key(d, 'target')} AS target, trim(anchor) AS anchor FROM @links@ WHERE type = '' OR lower(type) LIKE '%hyperlink%')"""


@operator
def analyze_anchors(d: Duck) -> str:
    """D8. Anchor texts by target of ``links`` (source, target, type, anchor): diversity, generic and empty ones, relevance, issues."""
    words = lambda s: d.extract_all(f"lower({s})", "[a-z]+")
    meets = f"{d.size(d.intersect(words('anchor'), words(d.extract('target', '^(?:[a-z]+://[^/]*)?(.*)$'))))} > 0"
    return f"""
SELECT target, total, unique_anchors, round(diversity, 4) AS diversity, generic, empty, round(relevance, 4) AS relevance,
  diversity < 15e-2 AND total > 3 AS over_optimized, generic > total * 30e-2 AS too_many_generic, empty > total * 50e-2 AS many_empty, relevance < 30e-2 AND total > 3 AS low_relevance
FROM (SELECT target, CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT CASE WHEN anchor <> '' THEN lower(anchor) END) AS BIGINT) AS unique_anchors,
  count(DISTINCT CASE WHEN anchor <> '' THEN lower(anchor) END) / CAST(count(*) AS DOUBLE) AS diversity, CAST(count_if(lower(anchor) IN ({_GENERIC})) AS BIGINT) AS generic,
  CAST(count_if(anchor = '') AS BIGINT) AS empty, count_if({meets}) / CAST(count(*) AS DOUBLE) AS relevance FROM {anchors_of(d)} AS a GROUP BY target) AS t"""


@operator
def duplicate_anchors(d: Duck, top: int = 30, first: int = 5) -> str:
    """D9. Anchors that say something and lead to more than one target, one row for each of their first targets."""
    return f"""
WITH ends AS (SELECT DISTINCT lower(anchor) AS anchor, target FROM {anchors_of(d)} AS a WHERE anchor <> ''),
found AS (SELECT anchor, CAST(count(*) AS BIGINT) AS targets FROM ends WHERE anchor NOT IN ({_GENERIC}) GROUP BY anchor HAVING count(*) > 1 ORDER BY targets DESC, anchor LIMIT {top})
SELECT anchor, targets, CAST(n AS BIGINT) AS target_rank, target FROM (
  SELECT f.anchor, f.targets, x.target, row_number() OVER (PARTITION BY f.anchor ORDER BY x.target) AS n FROM found f JOIN ends x ON f.anchor = x.anchor) AS r WHERE n <= {first}"""


@operator
def empty_anchors(d: Duck, top: int = 20) -> str:
    """D10. The targets that most links without an anchor lead to."""
    return f"""
SELECT target, CAST(count(*) AS BIGINT) AS empty FROM {anchors_of(d)} AS a WHERE anchor = '' GROUP BY target ORDER BY empty DESC, target LIMIT {top}"""


@operator
def generic_anchors(d: Duck, top: int = 20) -> str:
    """D10. The generic anchors in use, and how often they are."""
    return f"""
SELECT lower(anchor) AS anchor, CAST(count(*) AS BIGINT) AS uses FROM {anchors_of(d)} AS a WHERE lower(anchor) IN ({_GENERIC}) GROUP BY lower(anchor) ORDER BY uses DESC, anchor LIMIT {top}"""


@operator
def revenue_links(d: Duck) -> str:
    """D11, D12. Links in (all of them) against revenue by page: ``links`` and ``revenue`` (page, transactions, revenue, row_id), last row of a page."""
    return f"""
SELECT page, links_in, transactions, revenue, CASE WHEN links_in > 0 THEN round(revenue / links_in, 2) ELSE 0e0 END AS revenue_per_link,
  revenue > 0 AND links_in < 10 AS underlinked, revenue = 0 AND links_in > 10 AS overlinked
FROM (SELECT coalesce(l.target, r.page) AS page, coalesce(l.n, 0) AS links_in, coalesce(r.transactions, 0) AS transactions, coalesce(r.revenue, 0e0) AS revenue
  FROM (SELECT target, CAST(count(*) AS BIGINT) AS n FROM {anchors_of(d)} AS a GROUP BY target) AS l
  FULL OUTER JOIN (SELECT page, transactions, revenue FROM (SELECT page, transactions, revenue, row_number() OVER (PARTITION BY page ORDER BY row_id DESC) AS n FROM @revenue@) AS x WHERE n = 1) AS r
  ON l.target = r.page) AS f"""


@operator
def revenue_lists(d: Duck) -> str:
    """D12. Top lists of ``joined`` pages (page, links_in, revenue, revenue_per_link, underlinked, overlinked)."""
    lists = [
        ("underlinked", "underlinked", "revenue DESC", 30), ("overlinked", "overlinked", "links_in DESC", 30),
        ("most_efficient", "revenue > 0 AND links_in > 0", "revenue_per_link DESC", 20), ("least_efficient", "revenue > 0 AND links_in > 0", "revenue_per_link", 20),
    ]
    return " UNION ALL ".join(top_list(name, "@joined@", where, by, top, "page") for name, where, by, top in lists)


@operator
def link_blocks(d: Duck, client: str = "") -> str:
    """D13. Link blocks of ``blocks`` (site, block, links) by site, and those that the client lacks."""
    return f"""
SELECT b.block, CAST(count(DISTINCT b.site) AS BIGINT) AS sites, CAST(sum(b.links) AS BIGINT) AS links, max(CASE WHEN b.site = {text(client)} THEN 1 ELSE 0 END) = 0 AS missing_at_client
FROM @blocks@ b GROUP BY b.block"""


# --- iterative -----------------------------------------------------------------------------


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder of spark.checkpoint.dir (one of our own only where that is unset and the master is local)."""
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """B7, B20. (node, root): smallest node reachable over the undirected ``pairs`` (two columns of one type).

    Every round a node takes the smallest label among its neighbours, then the label of that
    label, so that long chains shrink by half and more.
    """
    a, b = pairs.columns
    edges = settled(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).union(pairs.select(b, a)).distinct())
    labels = settled(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("root")))
    for _ in range(most_rounds):
        near = edges.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("root").alias("m"))
        step = labels.join(near, F.col("node") == F.col("x")).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        jump = step.select(F.col("node").alias("at"), F.col("root").alias("up"))
        after = settled(step.join(jump, F.col("root") == F.col("at"), "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "was"))
        labels = after.select("node", "root")
        if after.filter("root <> was").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 100) -> DataFrame:
    """D3. (node, pagerank) of weighted ``edges`` (src, dst, weight); rank of dangling nodes is spread over all.

    Stops when the ranks move by less than the number of nodes times ``tolerance`` in sum.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    links = settled(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    nodes = settled(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().join(out.select(F.col("src").alias("node"), F.lit(True).alias("leads")), "node", "left"))
    n = nodes.count()
    ranks = nodes.select("node", "leads", F.lit(1.0 / max(n, 1)).alias("pagerank"))
    for _ in range(most_rounds):
        lost = ranks.filter("leads IS NULL").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0)).alias("s")).first()["s"]
        given = links.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        base = (1 - damping) / n + damping * lost / n
        after = ranks.join(given, F.col("node") == F.col("dst"), "left").select("node", "leads", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("pagerank"), F.col("pagerank").alias("was"))
        after = settled(after)
        moved = after.agg(F.coalesce(F.sum(F.abs(F.col("pagerank") - F.col("was"))), F.lit(0.0)).alias("s")).first()["s"]
        ranks = after.select("node", "leads", "pagerank")
        if moved < n * tolerance:
            break
    return ranks.select("node", "pagerank")


#: Nodes up to which betweenness is exact, and sources sampled above.
EXACT_NODES, SAMPLED_SOURCES = 10_000, 500


def betweenness(edges: DataFrame, seed: int = 42, exact_nodes: int | None = EXACT_NODES) -> DataFrame:
    """D4. (node, betweenness), normalised, of the directed graph ``edges`` (src, dst), unweighted.

    Nodes are numbered by range sorting. No path leads through a node that no edge leads to, so only edges between the others are
    sent to each task, as two arrays of numbers; sources are dealt over the tasks, each with the nodes it leads to. None of it passes
    through the driver. Above ``exact_nodes`` nodes a sample of sources stands for all; None: never.
    """
    from lodestar.operators.order import place_in

    spark = edges.sparkSession
    ship(spark)
    pairs = settled(edges.select("src", "dst").distinct())
    names = settled(place_in(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct(), [F.col("node")], "id"))
    n = names.count()
    number = lambda c: names.select(F.col("node").alias(c), (F.col("id") - 1).cast("int").alias(c[0]))
    numbered = settled(pairs.join(number("src"), "src").join(number("dst"), "dst").select("s", "d"))
    nodes = names.select((F.col("id") - 1).cast("int").alias("at"))
    exact = exact_nodes is None or n <= exact_nodes
    sources = nodes if exact else nodes.orderBy(F.xxhash64("at", F.lit(seed))).limit(SAMPLED_SOURCES)
    factor = (1.0 if exact else n / SAMPLED_SOURCES) / max((n - 1) * (n - 2), 1)
    tasks = spark.sparkContext.defaultParallelism
    starts = numbered.join(sources, F.col("s") == F.col("at"), "left_semi") if not exact else numbered
    # a key for each of the partitions, which are of a fixed number: small tables are not put together in one task
    place = F.pmod(F.hash("key"), F.lit(tasks))
    keys = [r["key"] for r in spark.range(64 * tasks).select(F.col("id").cast("int").alias("key")).groupBy(place.alias("place")).agg(F.min("key").alias("key")).collect()]
    task = F.element_at(F.array(*map(F.lit, keys)), (F.pmod("at", F.lit(len(keys))) + 1).cast("int"))
    dealt = starts.groupBy(F.col("s").alias("at")).agg(F.collect_list("d").alias("ahead")).withColumn("task", task).repartition(tasks, "task").groupBy("task")
    inner = numbered.join(numbered.select(F.col("d").alias("to")).distinct(), F.col("s") == F.col("to"), "left_semi")
    sent = inner.withColumn("task", F.explode(F.array(*map(F.lit, keys)))).repartition(tasks, "task").groupBy("task")

    def partial(mine: pa.Table, graph: pa.Table) -> pa.Table:
        ids, total = add_paths(graph["s"].to_numpy(), graph["d"].to_numpy(), mine["at"].to_numpy(), mine["ahead"].combine_chunks())
        found = np.flatnonzero(total)
        return pa.table({"at": pa.array(ids[found], pa.int64()), "part": pa.array(total[found], pa.float64())})

    sums = dealt.cogroup(sent).applyInArrow(partial, "at bigint, part double").groupBy("at").agg(F.sum("part").alias("b"))
    return names.join(sums, F.col("id") - 1 == F.col("at"), "left").select("node", (F.coalesce("b", F.lit(0.0)) * factor).alias("betweenness"))


#: Sources that go through the graph together, and numbers of a table of edges by sources at most.
BATCH_SOURCES, BATCH_CELLS = 128, 4_000_000
#: Edges of a node that are added one by one, for all nodes together.
LONG_LIST = 256


def add_paths(s: np.ndarray, d: np.ndarray, sources: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, each one's share of the shortest paths from ``sources``), which lead to ``lists``, on over the edges s - d.

    Sources are taken by the dozen, and those of one part of the graph together: what they reach is cut out, and each step
    is done for all of them by rows of numbers, one for each source.
    """
    bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))) if len(lists) else np.zeros(1, np.int64)
    heads = lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int32)
    ids = np.unique(np.concatenate((s, d, heads)))
    s, d, heads = (np.searchsorted(ids, x) for x in (s, d, heads))
    n, total = len(ids), np.zeros(len(ids))
    if not n:
        return ids, total
    own = np.searchsorted(ids, sources)
    own = np.where((own < n) & (ids[np.minimum(own, n - 1)] == sources), own, -1)
    order = np.argsort(s, kind="stable")
    s, d = s[order], d[order]
    start = np.searchsorted(s, np.arange(n + 1))
    # sources of one part of the graph next to each other
    part = np.arange(n)
    while True:
        low = part.copy()
        np.minimum.at(low, s, part[d])
        np.minimum.at(low, d, part[s])
        low = np.minimum(low, low[low])
        if np.array_equal(low, part):
            break
        part = low
    near = np.lexsort((sources, part[heads[bounds[:-1]]]))
    local = np.full(n, -1, np.int64)
    for at in range(0, len(near), BATCH_SOURCES):
        some = near[at : at + BATCH_SOURCES]
        row = np.concatenate([heads[bounds[k] : bounds[k + 1]] for k in some])
        column = np.repeat(np.arange(len(some)), bounds[some + 1] - bounds[some])
        # what any of them reaches
        front = np.unique(row)
        local[front] = 0
        reached, edges = [front], []
        while len(front):
            of = start[front + 1] - start[front]
            edge = np.arange(of.sum()) + np.repeat(start[front] - np.cumsum(of) + of, of)
            edges.append(edge)
            front = np.unique(d[edge][local[d[edge]] < 0])
            local[front] = 0
            reached.append(front)
        nodes, edge = np.sort(np.concatenate(reached)), np.sort(np.concatenate(edges))
        local[nodes] = np.arange(len(nodes))
        x, y = local[s[edge]], local[d[edge]]
        width = max(1, BATCH_CELLS // max(len(edge), len(nodes), 1))
        for first in range(0, len(some), width):
            few = (column >= first) & (column < first + width)
            mine = own[some[first : first + width]]
            inside = np.flatnonzero((mine >= 0) & (local[np.maximum(mine, 0)] >= 0))
            total[nodes] += _shares(x, y, len(nodes), local[row[few]], column[few] - first, len(mine), local[mine[inside]], inside)
        local[nodes] = -1
    return ids, total


def _summed(rows: np.ndarray, to: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums of the rows ``of`` by place) for the ascending places ``to``: the next row of all places at once, and of the longest ones at last."""
    cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    counts = np.diff(np.append(cuts, len(to)))
    by = np.argsort(-counts, kind="stable")
    cuts, counts = cuts[by], counts[by]
    got = rows[of[cuts]]
    ends = np.searchsorted(-counts, -np.arange(min(counts[0], LONG_LIST)), "left")
    for k in range(1, len(ends)):
        got[: ends[k]] += rows[of[cuts[: ends[k]] + k]]
    for i in np.flatnonzero(counts > LONG_LIST):
        got[i] += rows[of[cuts[i] + LONG_LIST : cuts[i] + counts[i]]].sum(axis=0)
    return to[cuts], got


def _shares(x: np.ndarray, y: np.ndarray, n: int, row: np.ndarray, column: np.ndarray, sources: int, own: np.ndarray, own_column: np.ndarray) -> np.ndarray:
    """Shares of ``n`` nodes, summed over the sources, in the paths over the edges x - y (by x) that begin with the nodes ``row`` of sources ``column``.

    Paths are counted by breadth, all edges of a level at once, then the shares from the far end back.
    """
    depth, paths, share = np.full((n, sources), -1, np.int16 if n < 32_000 else np.int32), np.zeros((n, sources)), np.zeros((n, sources))
    depth[own, own_column] = 0
    begins = depth[row, column] < 0
    depth[row[begins], column[begins]] = 1
    paths[row[begins], column[begins]] = 1.0
    by_y = np.argsort(y, kind="stable")
    xs, ys = x[by_y], y[by_y]
    level, front, active = 1, paths, np.unique(row[begins])
    while len(active):
        leads = np.zeros(n, bool)
        leads[active] = True
        wants = (depth < 0).any(axis=1)
        use = np.flatnonzero(leads[xs] & wants[ys])
        if not len(use):
            break
        level += 1
        to, got = _summed(front, ys[use], xs[use])
        new = (depth[to] < 0) & (got > 0)
        hit = np.flatnonzero(new.any(axis=1))
        active, got = to[hit], np.where(new[hit], got[hit], 0.0)
        depth[active] = np.where(new[hit], level, depth[active])
        paths[active] += got
        front = np.zeros((n, sources))
        front[active] = got
    while level > 1:
        here, above = depth == level, depth == level - 1
        pull = np.divide(1.0 + share, paths, out=np.zeros((n, sources)), where=here)
        use = np.flatnonzero(above.any(axis=1)[x] & here.any(axis=1)[y])
        if len(use):
            to, got = _summed(pull, x[use], y[use])
            share[to] += np.where(above[to], paths[to] * got, 0.0)
        level -= 1
    return share.sum(axis=1)
