"""Operator 5. Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised on their own, with a codebook of K centroids each,
so that K ** 2 pairs of centroids make the cells of the index; K grows as the square root of
the number of vectors. For a query the pairs are traversed with a heap in the order of their
summed nearness (the inner products of the query's halves with the centroids), until the
cells hold a share of all entries; the entries met are reranked by the exact inner product in
double precision.

The share is calibrated: a bounded sample of queries is compared with every vector, and the
share is the least one that meets the wanted recall on them. More vectors give more codes, and
a query's neighbours stand out more, so the share falls as the index grows.

Codebooks come from a bounded sample; every vector is indexed. Cells are dealt into shards in
their order, and a cell of more rows than a shard's is split by row. Entries move once, to
their shard; a query goes to the shards whose cells it visits, with the sum at which its traversal
stopped, and the shard finds by it which of its own cells are visited. Queries stream past a
shard's entries, so a task holds one shard and a batch of queries. There are about as many shards as
tasks run at once until SHARD_ROWS fill one, so what is moved grows with the number of vectors.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import col, map_rows, materialize
from lodestar.sources.shipping import ship

ROUNDS = 12
#: Codes of a half: the power of two nearest to the root of the number of vectors by CODES_ROOT, within these.
LEAST_CODES, MOST_CODES, CODES_ROOT = 8, 1_024, 6.0
#: Vectors that the codebooks are fitted on, and queries that the share is calibrated with, about.
SAMPLE, ASKED = 20_000, 128
#: Recall that the calibrated share meets on the sampled queries.
RECALL = 0.95
LEAST_SHARD_ROWS, SHARD_ROWS, AT_ONCE = 2_048, 131_072, 64
#: Below this part of a shard's rows a query's entries are gathered, above it all are multiplied.
GATHER = 0.1


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of at most k clusters; the same for the same points."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(0).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def traverse(u: np.ndarray, v: np.ndarray, held: np.ndarray, enough: float) -> tuple[list[int], float]:
    """Cells (i * len(v) + j) in falling order of u[i] + v[j], until they hold ``enough`` entries, and the last one's sum."""
    a, b = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
    x, y, ai, bj, m = u[a].tolist(), v[b].tolist(), a.tolist(), b.tolist(), len(v)
    count = held.tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    row = [0] * len(x)  # cells taken of each row; a cell opens when those above and left of it are taken
    found, total, stop = [], 0, -math.inf
    while heap and total < enough:
        stop, i, j = heapq.heappop(heap)
        stop = -stop
        row[i] = j + 1
        cell = ai[i] * m + bj[j]
        if count[cell]:
            found.append(cell)
            total += count[cell]
        if j + 1 < m and (i == 0 or row[i - 1] > j + 1):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if i + 1 < len(x) and row[i + 1] == j:
            heapq.heappush(heap, (-(x[i + 1] + y[j]), i + 1, j))
    return found, stop if total >= enough else -math.inf


def usable(vector: Column) -> Column:
    """Not null, not empty, finite in every component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def best(x: np.ndarray, v: np.ndarray, among: np.ndarray, near: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k rows of ``x`` nearest to ``v`` among those in ``among``, ties by ``order``, and their exact scores.

    ``near``: scores from a matrix product, right but for rounding. Whatever may be among the
    k is scored anew, row by row, so that equal vectors get equal scores.
    """
    if len(among) > k:
        bound = np.partition(near, len(near) - k)[len(near) - k]
        among = among[near >= bound - 1e-9 * max(1.0, abs(bound))]
    scores = (x[among] * v).sum(axis=1)
    first = np.lexsort((order[among], -scores))[:k]
    return among[first], scores[first]


def codes_for(n: int) -> int:
    """Centroids of each half for ``n`` vectors."""
    return int(min(MOST_CODES, max(LEAST_CODES, 2 ** round(math.log2(max(1.0, math.sqrt(n) / CODES_ROOT))))))


def deal(held: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard of each cell, and number of shards that a cell is split into: cells in order, up to ``shard_rows`` rows a shard."""
    parts = np.maximum(1, -(-held // shard_rows))
    first = np.zeros(len(held), np.int64)
    shard = rows = 0
    for c, (n, p) in enumerate(zip(held.tolist(), parts.tolist(), strict=True)):
        if rows and rows + n > shard_rows:
            shard, rows = shard + 1, 0
        first[c] = shard
        rows += n
        if p > 1:
            shard, rows = shard + p, 0
    return first, parts


def search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, share: float | None = None, codes: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``queries`` selects.

    ``queries`` is a condition on the id. Nearness is the inner product of the original
    vectors; ties go to the smaller id (a null one last). Every row is a candidate but the
    query's own: rows with the same id are candidates, and queries, each on its own. Vectors
    that are null, empty, zero or hold null or non-finite components take no part. A vector's
    candidates are those of its length. With no more than k candidates all are returned; an
    empty table gives no rows. Columns but id and vector are not read. Without ``share`` it is
    calibrated for ``recall``; without ``codes`` they grow with the number of vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(col(vec_id).cast("bigint").alias("vec_id"), col(embedding).cast("array<double>").alias("v"))
    rows = rows.withColumn("asked", F.coalesce(queries, F.lit(False))).filter(usable(F.col("v")))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # the row's number is fixed from here on
    lengths = [(r["d"], r["n"]) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()]
    found = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for d, n in sorted(lengths):
        found = found.unionByName(_search(rows.filter(F.size("v") == d), d, n, k, share, codes or codes_for(n), sample, recall))
    return found


def _calibrated(rows: DataFrame, codebooks: tuple[np.ndarray, np.ndarray], held: np.ndarray, n: int, k: int, recall: float) -> tuple[float, float]:
    """Share of the entries that finds ``recall`` of the k nearest of about ASKED sampled rows, compared with all rows; and the recall at it."""
    a, b = codebooks
    half = a.shape[1]
    drawn = _some(rows, n, ASKED).select("row", "v").toPandas().sort_values("row")
    asked, q = drawn["row"].to_numpy(), np.stack(drawn["v"].to_numpy())
    sent = rows.sparkSession.sparkContext.broadcast((asked, q))  # ASKED vectors, about

    def nearest_here(batches):
        own, x_q = sent.value
        for pdf in batches:
            x, at, cell = np.stack(pdf["v"].to_numpy()), pdf["row"].to_numpy(), pdf["cell"].to_numpy()
            s = x_q @ x.T
            s[own[:, None] == at[None]] = -np.inf
            few = min(k, s.shape[1])
            top = np.argpartition(-s, few - 1, axis=1)[:, :few]
            who = np.repeat(np.arange(len(x_q)), few)
            yield pd.DataFrame({"q": who, "score": np.take_along_axis(s, top, 1).ravel(), "cell": cell[top.ravel()]})

    all_near = rows.select("row", "v", "cell").mapInPandas(nearest_here, "q bigint, score double, cell bigint").filter("score > double('-infinity')")
    by_query = Window.partitionBy("q").orderBy(F.desc("score"))
    true = all_near.withColumn("r", F.row_number().over(by_query)).filter(F.col("r") <= k).select("q", "cell").toPandas()  # ASKED * k rows, about
    reached: list[float] = []
    for i, cells in true.groupby("q")["cell"]:
        sums = (q[i, :half] @ a.T)[:, None] + (q[i, half:] @ b.T)[None]
        flat = sums.ravel()
        reached += [held[flat >= flat[c]].sum() / n for c in cells]
    reached.sort()
    at = min(len(reached) - 1, math.ceil(recall * len(reached)) - 1)
    return float(reached[at]), (at + 1) / len(reached)


def _some(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` of the ``n`` rows, by a hash of the row's number."""
    return rows.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, n // most))) == 0)


def _search(rows: DataFrame, d: int, n: int, k: int, share: float | None, codes: int, sample: int, recall: float) -> DataFrame:
    """``search`` over ``n`` rows (vec_id, v, asked, row) of vectors of ``d`` components."""
    spark, half = rows.sparkSession, d // 2
    drawn = _some(rows, n, sample).select("row", "v").toPandas().sort_values("row")
    points = np.stack(drawn["v"].to_numpy()) if len(drawn) else np.zeros((1, d))
    del drawn
    books = spark.sparkContext.broadcast((kmeans(points[:, :half], codes), kmeans(points[:, half:], codes)))
    a, b = books.value

    def assign():
        a, b = books.value

        def step(cols):
            x = np.array(cols["v"]).reshape(-1, d)
            return {"v": list(x), "cell": nearest(x[:, :half], a) * len(b) + nearest(x[:, half:], b)}

        return step

    indexed = materialize(map_rows(rows.select("vec_id", "asked", "row", "v"), assign, "v array<double>, cell bigint", ["vec_id", "asked", "row"], 5_000), "index")
    held = np.zeros(len(a) * len(b), np.int64)  # MOST_CODES ** 2 counts at most
    for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        held[r["cell"]] = r["n"]
    if share is None:
        share = _calibrated(indexed, (a, b), held, n, k, recall)[0] if n > k + 1 else 1.0
    enough = max(share * n, k) + 1
    shard_rows = min(SHARD_ROWS, max(LEAST_SHARD_ROWS, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    first, parts = deal(held, shard_rows)
    plan_of = spark.sparkContext.broadcast((held, first, parts))

    def shards():
        _, first, parts = plan_of.value

        def step(cols):
            cell, row = np.array(cols["in_cell"], dtype=np.int64), np.array(cols["at_row"], dtype=np.int64)
            return {"shard": first[cell] + row % parts[cell]}

        return step

    def plan():
        (a, b), (held, first, parts) = books.value, plan_of.value

        def step(cols):
            x = np.array(cols["at_v"]).reshape(-1, d)
            u, w = x[:, :half] @ a.T, x[:, half:] @ b.T
            visits, stops = [], []
            for i in range(len(x)):
                cells, stop = traverse(u[i], w[i], held, enough)
                cells = np.array(cells, dtype=np.int64)
                split = cells[parts[cells] > 1]
                visits.append(np.unique(np.concatenate([first[cells], *[first[c] + np.arange(parts[c]) for c in split]])))
                stops.append(stop)
            return {"visits": visits, "stop": stops}

        return step

    asked = map_rows(indexed.filter("asked").select("vec_id", "row", "v", F.col("v").alias("at_v")), plan, "visits array<bigint>, stop double", ["vec_id", "row", "v"], 1_000)
    asked = asked.select("vec_id", "row", "v", F.lit(None).cast("bigint").alias("cell"), F.explode("visits").alias("shard"), "stop", F.lit(1).alias("kind"))
    entries = map_rows(indexed.select("vec_id", "row", "v", "cell", F.col("cell").alias("in_cell"), F.col("row").alias("at_row")), shards, "shard bigint", ["vec_id", "row", "v", "cell"], 5_000)
    entries = entries.select("vec_id", "row", "v", "cell", "shard", F.lit(None).cast("double").alias("stop"), F.lit(0).alias("kind"))
    # a shard's entries come first, and its queries stream past them: a stated set of queries against the rows they visit
    met = entries.unionByName(asked).repartition(int(first.max() + parts.max()), "shard").sortWithinPartitions("shard", "kind")

    def held_by(parts_of: list[pd.DataFrame]) -> dict:
        entries = pd.concat(parts_of).sort_values("cell", kind="stable").reset_index(drop=True)
        own, cells = entries["row"].to_numpy(), entries["cell"].to_numpy(dtype=np.int64)
        ids = entries["vec_id"].to_numpy(dtype=float, na_value=np.inf)  # only for the order: a null id is last
        order = np.empty(len(ids), np.int64)
        order[np.lexsort((own, ids))] = np.arange(len(ids))
        here, counts = np.unique(cells, return_counts=True)
        return {"own": own, "x": np.stack(entries["v"].to_numpy()), "ids": entries["vec_id"], "order": order, "here": here, "counts": counts}

    def answers(shard: dict, questions: pd.DataFrame) -> pd.DataFrame:
        (a, b), x, own = books.value, shard["x"], shard["own"]
        i, j = np.divmod(shard["here"], len(b))
        out: dict[str, list] = {"query_row": [], "query_id": [], "at": [], "score": []}
        for at in range(0, len(questions), AT_ONCE):
            some = questions.iloc[at : at + AT_ONCE]
            v, stop = np.stack(some["v"].to_numpy()), some["stop"].to_numpy(dtype=float)[:, None]
            sums = (v[:, :half] @ a.T)[:, i] + (v[:, half:] @ b.T)[:, j]
            visited = sums >= np.where(np.isfinite(stop), stop - 1e-9 * np.maximum(1.0, np.abs(stop)), stop)  # products may round in another way here
            dense = (visited @ shard["counts"]).sum() > GATHER * len(x) * len(v)
            near = v @ x.T if dense else None
            for r, (q, name) in enumerate(zip(some["row"], some["vec_id"], strict=True)):
                among = np.flatnonzero(np.repeat(visited[r], shard["counts"]) & (own != q))
                if len(among):
                    top, scores = best(x, v[r], among, near[r, among] if dense else x[among] @ v[r], shard["order"], k)
                    for c, values in (("query_row", np.full(len(top), q)), ("query_id", np.full(len(top), name)), ("at", top), ("score", scores)):
                        out[c].append(values)
        found = pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()}).astype({"query_row": "int64", "at": "int64", "score": "float64"})
        found["vec_id"] = shard["ids"].iloc[found["at"]].to_numpy() if len(found) else pd.Series([], dtype="int64")
        return found[["query_row", "query_id", "vec_id", "score"]]

    def stream(batches):
        now, gathered, shard = None, [], None
        for pdf in batches:
            for number, part in pdf.groupby("shard", sort=False):
                if number != now:
                    now, gathered, shard = number, [], None
                if len(entries := part[part["kind"] == 0]):
                    gathered.append(entries[["vec_id", "row", "v", "cell"]])
                if gathered and len(questions := part[part["kind"] == 1]):
                    if shard is None:
                        shard, gathered = held_by(gathered), gathered[:1]
                    yield answers(shard, questions)

    found = met.mapInPandas(stream, "query_row bigint, query_id bigint, vec_id bigint, score double")
    by_query = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
