"""Approximate nearest neighbours by inner product over balanced posting lists.

1. Place: vectors are scaled by the largest norm and lifted by one coordinate, sqrt(1 - |x|^2), to the unit sphere; queries lie there
   with 0 in it. The nearest point there is the largest inner product.
2. Lists: a sample of SAMPLE_ROWS rows and SAMPLE_BYTES at most, chosen by hash, is split again and again by k-means with a charge on
   full clusters, until each leaf holds its share of LIST_ROWS rows. The leaves' means are the centroids; they alone are fitted.
3. Graph: each centroid is linked with its nearest among those before it, both ways, so that the graph is connected. It is small (at
   most a sixteenth of the sample) and lies in each worker's memory.
4. Postings: every row goes to its nearest centroid's list, and to the lists of further centroids within the ratio BOUNDARY of that
   distance, REPLICAS in all, unless such a centroid is nearer to one already taken than to the row.
5. Search: a query takes all lists whose centroids are within the ratio PRUNE of its nearest one's distance, and more until they hold
   enough rows. Neighbouring lists form shards of about CELL_ROWS rows; a query is sent once to a shard. Shards that are longer, and
   the queries of one, are dealt into chunks, so a task holds CELL_ROWS rows and CELL_QUERIES queries, whatever a list holds.
   The lists nearest to a query are searched first, in its home shard. Its k-th best score there is the least that can be among its nearest, so
   from its other shards only rows that reach it are given back, and what comes back does not grow with the number of shards.
6. Scores are products of the original vectors in double precision, summed from the first component on.

Nulls: vectors null, zero or with null, NaN or infinite components take no part. Rows that share a vec_id are told apart; a row's
candidates are all other rows. A null vec_id is a candidate but no query, and comes first among ties. Shorter vectors are taken as
ending in zeros. Ties go to the smaller vec_id. Fewer candidates than asked for give fewer rows; an empty table gives an empty one.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.llm.scratch import table

SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20
LIST_ROWS = 256
#: Sample rows in a leaf, at least.
LEAF_ROWS = 16
BOUNDARY, REPLICAS = 1.03, 4
PRUNE = 1.15
#: Graph: links to earlier nodes, nodes at which each search begins, and how many of the nearest are always followed.
LINKS, ENTRIES, BEAM = 16, 16, 8
CELL_ROWS, CELL_QUERIES = 4096, 2048
#: Stands for a null vec_id on the way.
NO_ID = -(2**63)
#: Rows handled at once in a worker, and what their search of the graph holds besides their distances: links, and bytes of vectors.
BATCH = 512
EDGES, EDGE_BYTES = 1 << 18, 8 << 20


def _gaps(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all of ``q`` to all of ``c``."""
    return np.maximum((q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * q @ c.T, 0)


def balanced_centroids(x: np.ndarray, leaf: int, fan: int = 8, rounds: int = 8) -> np.ndarray:
    """Means of leaves of ``x`` with at most ``leaf`` rows (equal rows may fill a larger one), neighbours next to each other."""
    rng, out = np.random.default_rng(7), []
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        own = x[rows]
        k = min(fan, math.ceil(len(rows) / leaf))
        if k > 1 and (own != own[0]).any():
            centres = own[rng.choice(len(rows), k, replace=False)]
            charge = np.zeros(k)
            for _ in range(rounds):
                gaps = _gaps(own, centres)
                at = np.argmin(gaps + charge, 1)
                full = np.bincount(at, minlength=k)
                charge += 0.1 * gaps.mean() * (full * k / len(rows) - 1)
                centres = np.stack([own[at == j].mean(0) if full[j] else centres[j] for j in range(k)])
            parts = [rows[at == j] for j in range(k) if full[j]]
            if len(parts) > 1:
                todo.extend(reversed(parts))
                continue
        out.append(own.mean(0))
    means = np.stack(out)
    return means[np.sort(np.unique(means, axis=0, return_index=True)[1])]


class Graph:
    """Centroids, and links between them that lead to a point's nearest."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = centroids
        self.norms = (centroids**2).sum(1)
        links: list[set[int]] = [set() for _ in centroids]
        for begin in range(0, len(centroids), 1024):
            block = _gaps(centroids[begin : begin + 1024], centroids)
            for k, row in enumerate(block, begin):
                near = np.argsort(row[:k], kind="stable")[:LINKS]
                links[k].update(near.tolist())
                for j in near.tolist():
                    links[j].add(k)
        #: All nodes' links one after another: a few nodes have very many.
        self.links = np.array([j for x in links for j in sorted(x)], int)
        self.degree = np.array([len(x) for x in links])
        self.start = np.cumsum(self.degree) - self.degree
        self.entries = np.unique(np.linspace(0, len(centroids) - 1, min(ENTRIES, len(centroids))).astype(int))

    def search(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Distances of each of ``q`` to the centroids met, infinite for others: all is followed that lies within ``ratio`` of the nearest, and the BEAM nearest."""
        far = np.full((len(q), len(self.c)), np.inf)
        own = (q * q).sum(1)
        far[:, self.entries] = np.sqrt(_gaps(q, self.c[self.entries]))
        followed = np.zeros(far.shape, bool)
        while True:
            edge = np.partition(far, min(BEAM, far.shape[1]) - 1, axis=1)[:, min(BEAM, far.shape[1]) - 1]
            open_ = ~followed & np.isfinite(far) & (far <= np.maximum(far.min(1) * ratio, edge)[:, None])
            at, node = np.nonzero(open_)
            if not len(at):
                return far
            followed[at, node] = True
            met = np.zeros(far.shape, bool)
            ends = np.cumsum(self.degree[node])
            for part in np.split(np.arange(len(at)), np.searchsorted(ends, np.arange(EDGES, ends[-1], EDGES), "right")):
                each = self.degree[node[part]]
                link = np.arange(each.sum()) + np.repeat(self.start[node[part]] - np.cumsum(each) + each, each)
                met[np.repeat(at[part], each), self.links[link]] = True
            at, node = np.nonzero(met & np.isinf(far))
            step = max(1, EDGE_BYTES // (8 * q.shape[1]))
            for a in range(0, len(at), step):
                row, to = at[a : a + step], node[a : a + step]
                gap = own[row] + self.norms[to] - 2 * np.einsum("ij,ij->i", q[row], self.c[to])
                far[row, to] = np.sqrt(np.maximum(gap, 0))


class Place:
    """From vectors to points of the unit sphere whose distances order inner products."""

    def __init__(self, width: int, largest: float, norm: float) -> None:
        self.width, self.largest, self.norm = width, largest, norm

    def stacked(self, vectors: pd.Series) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        for k, v in enumerate(vectors):
            out[k, : len(v)] = v
        return out

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / self.largest / self.norm
        return np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0))])

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / np.abs(vectors).max(1, keepdims=True)
        return np.hstack([x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))])


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(uid, vec_id, v) of the rows that take part, as a written table; uid tells rows apart."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    kept = rows.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull()).filter(F.coalesce(sound, F.lit(False)))
    return table(kept.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v"), "vectors")


def sampled(rows: DataFrame, n: int, place: Place) -> np.ndarray:
    """A bounded sample of ``rows`` (of ``n``), the same at each run."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * place.width)))
    share = F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) / float(1 << 30)
    got = rows.filter(share < 0.9 * most / n).limit(most) if most < n else rows.limit(most)
    return place.rows(place.stacked(got.orderBy("uid").toPandas()["v"]))


def _postings(graph: Graph, place: Place):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in (whole.iloc[a : a + BATCH] for a in range(0, len(whole), BATCH)):
                far = graph.search(place.rows(place.stacked(pdf["v"])), BOUNDARY)
                order = np.argsort(far, axis=1, kind="stable")[:, : max(REPLICAS * 2, 1)]
                at, lists = [], []
                for k, near in enumerate(order):
                    taken: list[int] = []
                    for j in near.tolist():
                        if len(taken) == REPLICAS or far[k, j] > far[k, near[0]] * BOUNDARY:
                            break
                        if not taken or ((graph.c[taken] - graph.c[j]) ** 2).sum(1).min() > far[k, j] ** 2:
                            taken.append(j)
                    at.extend([k] * len(taken))
                    lists.extend(taken)
                out = pdf.iloc[at][["uid", "vec_id", "v"]]
                yield out.assign(list=np.array(lists, "int32"), first=np.r_[True, np.diff(at) > 0] if at else np.array([], bool))

    return run


def _probes(graph: Graph, place: Place, sizes: np.ndarray, shard_of: np.ndarray, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in (whole.iloc[a : a + BATCH] for a in range(0, len(whole), BATCH)):
                points = place.queries(place.stacked(pdf["v"]))
                far = graph.search(points, PRUNE)
                taken = far <= far.min(1)[:, None] * PRUNE
                for k in np.nonzero(taken @ sizes < least)[0]:
                    #: Too few rows nearby: lists by distance until they suffice.
                    order = np.argsort(_gaps(points[k : k + 1], graph.c)[0], kind="stable")
                    taken[k, order[: np.searchsorted(np.cumsum(sizes[order]), least) + 1]] = True
                at, lists = np.nonzero(taken)
                got = pd.DataFrame({"k": at, "shard": shard_of[lists], "lists": lists}).groupby(["k", "shard"], sort=False)["lists"].agg(list).reset_index()
                out = pdf.iloc[got["k"]][["uid", "vec_id", "v"]].reset_index(drop=True)
                home = shard_of[np.where(taken, far, np.inf).argmin(1)]
                yield out.assign(shard=got["shard"].astype("int32"), lists=got["lists"], home=got["shard"].to_numpy() == home[got["k"]])

    return run


def _best(place: Place, wanted: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            rank = rows.sort_values(["vec_id", "uid"])
            v, uid, lists = place.stacked(rank["v"]), rank["uid"].to_numpy(), rank["list"].to_numpy()
            for a in range(0, len(queries), 256):
                some = queries.iloc[a : a + 256]
                q, own, least = place.stacked(some["v"]), some["uid"].to_numpy(), some["least"].to_numpy(float)
                local = {x: k for k, x in enumerate(np.unique(lists).tolist())}
                met = np.zeros((len(some), len(local)), bool)
                for k, probes in enumerate(some["lists"]):
                    met[k, [local[x] for x in probes if x in local]] = True
                with np.errstate(all="ignore"):
                    rough = q @ v.T
                rough = np.where(met[:, np.vectorize(local.get, otypes=[int])(lists)] & (own[:, None] != uid[None, :]), rough, -np.inf)
                #: A row stands in as many lists of the shard as it was replicated to, so more places than asked for are looked at.
                depth = min(wanted * REPLICAS, rough.shape[1])
                edge = -np.partition(-rough, depth - 1, axis=1)[:, depth - 1]
                slack = 1e-9 * np.abs(q).sum(1) * max(np.abs(v).max(), 1e-300)
                at, row = np.nonzero(np.isfinite(rough) & (rough >= (edge - slack)[:, None]))
                exact = np.zeros(len(at))
                for d in range(place.width):
                    exact += q[at, d] * v[row, d]
                #: Rows are in the order of their ids already, so a stable sort by score breaks ties.
                order = np.lexsort((row, -exact, at))
                order = order[~(exact[order] < least[at[order]])]
                at, row, exact = at[order], row[order], exact[order]
                pairs = pd.DataFrame({"at": at, "uid": uid[row], "row": row, "score": exact}).drop_duplicates(["at", "uid"])
                pairs = pairs[pairs.groupby("at").cumcount() < wanted]
                found.append(pd.DataFrame({
                    "query_uid": own[pairs["at"]], "query_id": some["vec_id"].to_numpy()[pairs["at"]], "uid": pairs["uid"].to_numpy(),
                    "vec_id": rank["vec_id"].to_numpy()[pairs["row"]], "score": pairs["score"].to_numpy(),
                }))
        if not found:
            return pd.DataFrame({"query_uid": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "uid": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return pd.concat(found, ignore_index=True)

    return run


def nearest(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose key is divisible by ``every``."""
    spark = rows.sparkSession
    have = usable(rows, key, vector)
    n, width, largest = have.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = have.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest)))).first()[0] ** 0.5
    place = Place(width, largest, norm)
    sample = sampled(have, n, place)
    leaf = max(min(LEAF_ROWS, len(sample)), math.ceil(LIST_ROWS * len(sample) / n))
    graph = Graph(balanced_centroids(sample, leaf))

    kept = "uid long, vec_id long, v array<double>"
    postings = table(have.mapInPandas(_postings(graph, place), f"{kept}, list int, first boolean"), "postings")
    #: One row for each list: at most as many as centroids.
    count = {r["list"]: r for r in postings.groupBy("list").agg(F.count("*").alias("all"), F.count_if("first").alias("own")).collect()}
    full = np.array([count[j]["all"] if j in count else 0 for j in range(len(graph.c))])
    own = np.array([count[j]["own"] if j in count else 0 for j in range(len(graph.c))])
    shard_of = (np.cumsum(full) - full) // CELL_ROWS
    shard_rows = np.bincount(shard_of, weights=full)

    queries = have.filter(F.col("vec_id") % every == 0)
    probes = table(queries.mapInPandas(_probes(graph, place, own, shard_of, k + 1), f"{kept}, shard int, lists array<int>, home boolean"), "probes")
    asked = {r["shard"]: r["n"] for r in probes.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    cells = [(int(s), math.ceil(shard_rows[s] / CELL_ROWS) or 1, math.ceil(asked[s] / CELL_QUERIES)) for s in sorted(asked)]
    cells = F.broadcast(spark.createDataFrame(cells, "shard int, n_rows int, n_queries int"))
    shards = F.broadcast(spark.createDataFrame([(int(j), int(s)) for j, s in enumerate(shard_of)], "list int, shard int"))
    deal = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = postings.join(shards, "list").join(cells, "shard").select("shard", deal("n_rows").alias("part"), each("n_queries").alias("turn"), "uid", "vec_id", "v", "list")
    at = ["shard", "part", "turn"]

    def searched(some: DataFrame) -> DataFrame:
        #: A list that is in several chunks is all there for a query that asks for it, so no chunk's best are lost.
        left = some.join(cells, "shard").select("shard", each("n_rows").alias("part"), deal("n_queries").alias("turn"), "uid", "vec_id", "v", "lists", "least")
        return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(_best(place, k), "query_uid long, query_id long, uid long, vec_id long, score double")

    first = table(searched(probes.filter("home").withColumn("least", F.lit(None).cast("double"))), "found")
    ordered = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "uid")
    reached = first.select("query_uid", "score", F.row_number().over(ordered).alias("n_")).filter(F.col("n_") == k).select(F.col("query_uid").alias("uid"), F.col("score").alias("least"))
    found = first.unionByName(searched(probes.filter("not home").join(reached, "uid", "left")))
    #: A pair found in two lists has one rank; the limit on ranks also works before the shuffle.
    rank = F.dense_rank().over(Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id", "uid"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_uid", "query_id", "rank", "vec_id", "score").distinct()
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
