"""Exact top-k by inner product: best-first search in M-trees.

Vectors get one more coordinate, sqrt(M - |x|^2) with M the greatest squared norm, under which all have the same
norm and a query's (with 0 there) nearest neighbours are those of the greatest inner product. In this metric the rows
are dealt out to the nearest of a few pivots, large clusters in several blocks, and every block is an M-tree: nodes
of bounded size, each with a routing vector, the radius that covers all below it, and its distance to the parent's
routing vector. A search visits nodes by their least possible distance, and leaves out, before any distance is
computed, whatever the stored parent distances and the triangle inequality put out of reach.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regolith.llm.common import discard, stored, table

#: Pivots are a sample: the rows of the smallest id hashes, at most so many. Every row is indexed all the same.
PIVOTS = 64
#: Rows of a block, entries of a node, and queries that are searched in a block at a time.
BLOCK, NODE, QUERIES = 4096, 128, 256
#: Distances are floating-point; a bound must be missed by this share of the largest norm to count.
SLACK = 1e-7


def quantised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id (long) and v: floor(256 * x) of each component as long. Rows with a null id or vector, or with a null or
    non-finite component, are left out."""
    x = F.transform(vector, lambda c: c.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null")
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(good).select("id", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the rows of a and the vector b."""
    return np.sqrt(((a - b) ** 2).sum(1))


def lifted(v: np.ndarray, norm: float) -> np.ndarray:
    """The vectors with the coordinate that brings their squared norms to `norm`."""
    v = v.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(norm - (v * v).sum(1), 0))[:, None]], 1)


class Tree:
    """An M-tree over the rows of v. Nodes come before their children; a leaf's entries and a node's children are
    ranges first..last. router is an entry, to the distance between it and the parent's router."""

    ARRAYS = ("ids", "v", "leaf", "first", "last", "router", "radius", "to", "entry_to")

    def __init__(self, norm: float, **arrays: np.ndarray) -> None:
        self.norm = norm
        for k in self.ARRAYS:
            setattr(self, k, arrays[k])
        self.at = lifted(self.v[self.router], norm)  # routing vectors

    @classmethod
    def build(cls, ids: np.ndarray, v: np.ndarray, norm: float) -> Tree:
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        x = lifted(v, norm)
        nodes: list[list] = []  # members, router, distance to the parent's, first, last, leaf, radius
        todo = [(np.arange(len(ids)), 0, 0.0)]
        entries: list[np.ndarray] = []
        entry_to: list[np.ndarray] = []
        filled = done = 0
        nodes.append([todo[0][0], 0, 0.0, 0, 0, True, 0.0])
        while done < len(nodes):
            node = nodes[done]
            members, router = node[0], node[1]
            d = distances(x[members], x[router])
            node[6] = float(d.max())
            if len(members) <= NODE:
                node[3], node[4] = filled, filled + len(members)
                filled += len(members)
                entries.append(members)
                entry_to.append(d)
            else:
                many = min(NODE, -(-2 * len(members) // NODE))
                by = members[np.argsort(d, kind="stable")]
                routers = np.unique(by[np.linspace(0, len(by) - 1, many).astype(int)])
                near = np.stack([distances(x[members], x[r]) for r in routers]).argmin(0)
                parts = [(members[near == i], r) for i, r in enumerate(routers)]
                if max(len(p) for p, _ in parts) > 0.9 * len(members):  # equal vectors: cut them up as they come
                    parts = [(p[i : i + NODE], r) for p, r in parts for i in range(0, len(p), NODE)]
                parts = [(p, r) for p, r in parts if len(p)]
                node[3], node[4], node[5] = len(nodes), len(nodes) + len(parts), False
                nodes += [[p, int(r), float(distances(x[r : r + 1], x[router])[0]), 0, 0, True, 0.0] for p, r in parts]
            node[0] = None
            done += 1
        entries = np.concatenate(entries)
        place = np.empty(len(entries), np.int64)
        place[entries] = np.arange(len(entries))
        column = lambda i, kind: np.array([n[i] for n in nodes], kind)
        return cls(
            norm, ids=ids[entries], v=v[entries], leaf=column(5, bool), first=column(3, np.int64), last=column(4, np.int64),
            router=place[column(1, np.int64)], radius=column(6, np.float64), to=column(2, np.float64), entry_to=np.concatenate(entry_to),
        )

    def row(self) -> dict:
        return {"norm": self.norm, "n": len(self.ids)} | {k: getattr(self, k).tobytes() for k in self.ARRAYS}

    @classmethod
    def of(cls, row: dict, wide: str) -> Tree:
        kinds = dict(zip(cls.ARRAYS, (np.int64, wide, bool, np.int64, np.int64, np.int64, np.float64, np.float64, np.float64)))
        arrays = {k: np.frombuffer(row[k], kind) for k, kind in kinds.items()}
        arrays["v"] = arrays["v"].reshape(row["n"], -1)
        return cls(row["norm"], **arrays)

    def search(self, own: int, q: np.ndarray, k: int, found: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
        """The k best (-score, id) of `found` and of the entries with another id than `own`, and how many distances
        and products were computed."""
        whole = q.astype(np.int64)
        f = q.astype(np.float64)
        squared = float(f @ f)
        slack = SLACK * math.sqrt(max(squared, self.norm, 1.0))

        def reach() -> float:
            if len(found) < k:
                return math.inf
            return math.sqrt(max(squared + self.norm + 2 * found[-1][0], 0)) + slack

        def to_router(nodes: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(squared + self.norm - 2 * (self.at[nodes, :-1] @ f), 0))

        far = reach()
        d = float(to_router(np.array([0]))[0])
        computed = 1
        queue = [(max(d - self.radius[0], 0.0), 0, d)]
        while queue:
            least, node, d = heapq.heappop(queue)
            if least > far:
                break
            span = slice(self.first[node], self.last[node])
            if self.leaf[node]:
                at = np.flatnonzero(np.abs(d - self.entry_to[span]) <= far) + span.start
                at = at[self.ids[at] != own]
                if len(at):
                    scores = self.v[at].astype(np.int64) @ whole
                    computed += len(at)
                    best = np.lexsort((self.ids[at], -scores))[:k]
                    found = sorted([*found, *((-int(scores[i]), int(self.ids[at[i]])) for i in best)])[:k]
                    far = reach()
            else:
                kids = np.arange(span.start, span.stop)
                kids = kids[np.abs(d - self.to[kids]) - self.radius[kids] <= far]
                if len(kids):
                    ds = to_router(kids)
                    computed += len(kids)
                    for kid, kd in zip(kids.tolist(), ds.tolist()):
                        low = max(kd - self.radius[kid], 0.0)
                        if low <= far:
                            heapq.heappush(queue, (low, kid, kd))
        return found, computed


TREE_SCHEMA = "dim int, pivot int, part int, norm double, n long, " + ", ".join(f"{k} binary" for k in Tree.ARRAYS)
FOUND = "query_id long, dim int, pivot int, part int, found array<struct<score: long, vec_id: long>>, computed long"


def searched(pairs: DataFrame, k: int, wide: str) -> DataFrame:
    """Searches each row's tree for each of its queries (id, v, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                tree = Tree.of(row, wide)
                out = []
                for q in row["queries"]:
                    start = sorted((-x["score"], x["vec_id"]) for x in q["found"])
                    known = set(start)
                    best, computed = tree.search(q["id"], np.array(q["v"], np.int64), k, start)
                    new = [{"score": -s, "vec_id": v} for s, v in best if (s, v) not in known]
                    out.append((q["id"], row["dim"], row["pivot"], row["part"], new, computed))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND_TYPES)], ["query_id", "dim", "pivot", "part", "found", "computed"])

    return pairs.mapInArrow(run, FOUND)


FOUND_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())])), pa.int64())


class Forest:
    """The index of a frame: one tree a row in `trees`; what is known of the clusters is small and on the driver."""

    def __init__(self, df: DataFrame, key: str, vector: str) -> None:
        """Two passes for statistics and pivots, one shuffle of the quantised rows by block. Vectors of another
        number of components are clusters of their own, and never meet."""
        rows = quantised(df, key, vector)
        size = F.aggregate("v", F.lit(0).cast("double"), lambda a, c: a + c.cast("double") * c.cast("double"))
        stats = rows.groupBy(F.size("v").alias("dim")).agg(F.max(size).alias("norm"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).collect()
        self.norms = {r.dim: float(r.norm) for r in stats}
        self.wide = "<i4" if all((r.most or 0) < 2**31 for r in stats) else "<i8"
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
        self.pivots: dict[int, np.ndarray] = {}
        for dim in {len(r.v) for r in sample}:
            own = np.unique(np.array([r.v for r in sample if len(r.v) == dim], np.int64).reshape(-1, dim), axis=0)
            self.pivots[dim] = lifted(own, self.norms[dim])
        pivots, norms, wide = self.pivots, self.norms, self.wide

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    dim = len(v)
                    v = np.array(v, np.int64).reshape(1, dim)
                    at, d = -1, 0.0
                    if dim in pivots:
                        ds = distances(pivots[dim], lifted(v, norms[dim])[0])
                        at = int(ds.argmin())
                        d = float(ds[at])
                    out.append((i, dim, at, d, v.astype(wide).tobytes()))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["id", "dim", "pivot", "d", "v"])

        placed = stored(rows.mapInArrow(near, "id long, dim int, pivot int, d double, v binary"), "mtree-rows")
        counts = placed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()
        #: (dim, pivot): blocks, covering radius
        self.clusters = {(r.dim, r.pivot): (-(-r.n // BLOCK), float(r.radius)) for r in counts}
        spark = df.sparkSession
        blocks = spark.createDataFrame([(d, p, n) for (d, p), (n, _) in self.clusters.items()], "dim int, pivot int, parts long")

        def build(key: tuple, rows: pa.Table) -> pa.Table:
            dim, pivot, part = (x.as_py() for x in key)
            v = np.frombuffer(b"".join(rows["v"].to_pylist()), wide).reshape(rows.num_rows, dim)
            tree = Tree.build(rows["id"].to_numpy(), v, norms[dim])
            return pa.Table.from_pylist([{"dim": dim, "pivot": pivot, "part": part} | tree.row()], schema=BUILT)

        # one row for each of at most PIVOTS clusters and for each number of components
        dealt = placed.join(F.broadcast(blocks), ["dim", "pivot"]).withColumn("part", F.expr("cast(pmod(xxhash64(id, v), parts) as int)"))
        self.trees = stored(dealt.select("dim", "pivot", "part", "id", "v").groupBy("dim", "pivot", "part").applyInArrow(build, TREE_SCHEMA), "mtree-trees")
        discard(spark, placed)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, vec_id and score of the k best rows for each query (id, v), ties to the smaller vec_id.

        First each query is searched in one block of its nearest pivot's cluster, which gives a bound; then in all
        blocks of those clusters that the bound leaves. Queries go to a block in groups of about QUERIES."""
        clusters, pivots, norms = self.clusters, self.pivots, self.norms

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if len(v) in norms:
                        p = int((-2 * pivots[len(v)][:, :-1] @ np.array(v, np.float64)).argmin()) if len(v) in pivots else -1
                        if (len(v), p) in clusters:
                            rows.append((i, v, [], len(v), p, i % clusters[len(v), p][0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ROUTED)], ["id", "v", "found", "dim", "pivot", "part"])

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    dim, v = len(r["v"]), np.array(r["v"], np.float64)
                    squared = float(v @ v)
                    far = math.inf
                    if len(r["found"]) >= k:
                        worst = min(x["score"] for x in r["found"])
                        far = math.sqrt(max(squared + norms[dim] - 2 * worst, 0)) + SLACK * math.sqrt(max(squared, norms[dim], 1.0))
                    for (d, p), (parts, radius) in clusters.items():
                        if d != dim:
                            continue
                        if p >= 0 and math.sqrt(max(squared + norms[dim] - 2 * float(pivots[dim][p, :-1] @ v), 0)) - radius > far:
                            continue
                        rows += [(r["id"], r["v"], r["found"], d, p, part) for part in range(parts) if (p, part) != (r["pivot"], r["part"])]
                    while len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[:4096]), ROUTED)], ["id", "v", "found", "dim", "pivot", "part"])
                        rows = rows[4096:]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ROUTED)], ["id", "v", "found", "dim", "pivot", "part"])

        routed = "id long, v array<long>, found array<struct<score: long, vec_id: long>>, dim int, pivot int, part int"
        queries = stored(queries.groupBy("id").agg(F.min("v").alias("v")), "mtree-queries")
        groups = max(1, queries.count() // QUERIES)

        def meet(to: DataFrame) -> DataFrame:
            group = F.expr(f"cast(pmod(xxhash64(id), {groups}) as int)")
            grouped = to.groupBy("dim", "pivot", "part", group.alias("g")).agg(F.collect_list(F.struct("id", "v", "found")).alias("queries"))
            return stored(searched(grouped.drop("g").join(self.trees, ["dim", "pivot", "part"]), k, self.wide), "mtree-found")

        begun = meet(queries.mapInArrow(first, routed))
        known = begun.select(F.col("query_id").alias("id"), "found", "pivot", "part").join(queries, "id")
        ended = meet(known.select("id", "v", "found", "pivot", "part").mapInArrow(rest, routed))
        every = begun.unionAll(ended).select("query_id", F.explode("found").alias("f")).select("query_id", "f.vec_id", "f.score")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


BUILT = pa.schema([("dim", pa.int32()), ("pivot", pa.int32()), ("part", pa.int32()), ("norm", pa.float64()), ("n", pa.int64()), *((k, pa.binary()) for k in Tree.ARRAYS)])
ROUTED = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())])), pa.int32(), pa.int32(), pa.int32())


def top_k(df: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """The k rows of the greatest integer inner product for each row that is a query, by an index over all rows.

    A row is no candidate for queries of its own id; rows that repeat an id are candidates for the others each, and
    one query. Scores must fit in a long. Fewer than k candidates give fewer rows; an empty frame gives none."""
    if df.limit(1).count() == 0 or not (forest := Forest(df, key, vector)).clusters:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return forest.search(quantised(df.where(is_query), key, vector), k)


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for every fiftieth."""
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)


ORACLE_OP2 = """
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM rows q JOIN rows c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
