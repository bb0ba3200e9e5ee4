"""What the two vector searches share: shards by a kd-tree, an index written once, routing, merging.

Rows are dealt to shards by the median splits of a bounded sample (`Router`), so a shard is a region
of the index space; a region with too many rows (many equal vectors, say) is split by the hash of
the keys. Every shard becomes one row of a written index: its rows in the order of its own kd-tree,
and the tree's tight boxes. Candidates are shuffled once, for that.

A query is answered by its own shard first. The k-th score found there is propagated: the query
goes on only to shards whose box may hold something better (`Space.reach`), and starts there with
what it has found. Queries stream past an index row, so a task holds one shard and one batch of
queries, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm._common import materialize

#: Values (rows times dimensions) of a shard, about; a shard with twice as many is split.
SHARD_VALUES = 2_000_000
#: Rows that a shard should have at least before tables are split for the sake of parallel work.
SHARD_ROWS = 2048
#: Values of the sample that the router is fitted on, and sampled rows per region at least.
SAMPLE_VALUES, REGION_ROWS = 1 << 20, 16
#: Shards whose boxes a task holds while it routes queries, and queries of such a task.
BOX_GROUP, ROUTED = 1024, 1 << 16
#: Rows per leaf of a kd-tree.
LEAF = 128


def valid(table: DataFrame, vector: str, nonzero: bool) -> Column:
    """True for vectors without null or non-finite components (nor all zero, if ``nonzero``)."""
    v = F.col(vector)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return good & F.exists(v, lambda x: x != 0) if nonzero else good


def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, len(flat) // n if n else 0)


class Tree:
    """A kd-tree: median splits on the widest side, tight boxes around every node's rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        self.order = np.arange(n)
        lows, highs, nodes = [], [], []
        stack = [(0, n, -1)]
        while stack:
            s, e, parent = stack.pop()
            rows = points[self.order[s:e]]
            lo, hi = rows.min(axis=0), rows.max(axis=0)
            me = len(nodes)
            lows.append(lo)
            highs.append(hi)
            nodes.append([s, e, -1, -1])
            if parent >= 0:
                nodes[parent][2 if nodes[parent][2] < 0 else 3] = me
            if e - s > leaf and (hi > lo).any():
                axis = int((hi - lo).argmax())
                mid = (e - s) // 2
                self.order[s:e] = self.order[s:e][np.argpartition(rows[:, axis], mid)]
                stack += [(s, s + mid, me), (s + mid, e, me)]
        self.lo, self.hi, self.nodes = np.array(lows), np.array(highs), np.array(nodes, np.int64)


class Router:
    """Median splits of a sample into about ``regions`` parts; equal points are never parted."""

    def __init__(self, points: np.ndarray, regions: int):
        self.axis, self.cut, self.kids, self.region = [], [], [], []
        self.regions = self.depth = 0
        self._split(points, max(1, regions), 1)
        self.axis, self.cut, self.kids, self.region = np.array(self.axis), np.array(self.cut), np.array(self.kids), np.array(self.region)

    def _split(self, points: np.ndarray, parts: int, depth: int) -> int:
        me = len(self.axis)
        self.depth = max(self.depth, depth)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.kids.append((me, me))
        self.region.append(-1)
        width = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        if parts < 2 or not width.size or width.max() <= 0:
            self.region[me] = self.regions
            self.regions += 1
            return me
        axis = int(width.argmax())
        x = points[:, axis]
        at = max(1, len(x) * (parts // 2) // parts)
        cut = np.partition(x, at - 1)[at - 1]
        if cut == x.max():
            cut = x[x < cut].max()
        self.axis[me], self.cut[me] = axis, cut
        self.kids[me] = (self._split(points[x <= cut], parts // 2, depth + 1), self._split(points[x > cut], parts - parts // 2, depth + 1))
        return me

    def assign(self, points: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth - 1):
            axis = self.axis[at]
            right = points[rows, np.maximum(axis, 0)] > self.cut[at] if points.shape[1] else np.zeros(len(at), bool)
            at = self.kids[at, right.astype(np.int64)]
        return self.region[at]


class Shard:
    """One row of the index: rows in tree order, with node boxes in index space."""

    def __init__(self, ids, points, coords, lo, hi, nodes):
        self.ids, self.points, self.coords, self.lo, self.hi, self.nodes = ids, points, coords, lo, hi, nodes

    @classmethod
    def build(cls, space: Space, ids: np.ndarray, points: np.ndarray) -> Shard:
        coords = space.rows(points)
        tree = Tree(coords)
        return cls(ids[tree.order], points[tree.order], coords[tree.order], tree.lo, tree.hi, tree.nodes)

    COLUMNS = "ids binary, points binary, lo binary, hi binary, nodes binary"

    def pack(self) -> list[bytes]:
        return [np.ascontiguousarray(x).tobytes() for x in (self.ids, self.points, self.lo, self.hi, self.nodes)]

    @classmethod
    def unpack(cls, space: Space, ids: bytes, points: bytes, lo: bytes, hi: bytes, nodes: bytes) -> Shard:
        ids, nodes = np.frombuffer(ids, np.int64), np.frombuffer(nodes, np.int64).reshape(-1, 4)
        points = np.frombuffer(points).reshape(len(ids), -1)
        return cls(ids, points, space.rows(points), np.frombuffer(lo).reshape(len(nodes), -1), np.frombuffer(hi).reshape(len(nodes), -1), nodes)


class Space:
    """What a search must say; its objects go to the workers, so they are small."""

    #: Type of a score, and whether vectors of zeros take part.
    score_type, zeros = "double", True

    def prepare(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as they are compared."""
        return vectors

    def rows(self, points: np.ndarray) -> np.ndarray:
        """Coordinates of candidates in index space."""
        return points

    def reach(self, lo: np.ndarray, hi: np.ndarray, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Whether each box (column) must be visited for each query (row) with that k-th score."""
        raise NotImplementedError

    def search(self, shard: Shard, query_ids, queries, kths, near: list, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Per query: ids and scores of this shard that are among the k best with ``near``, rows verified.

        ``near`` has a query's (ids, scores) from elsewhere; ``kths`` their k-th scores, or -inf.
        """
        raise NotImplementedError


def merge(ids: np.ndarray, scores: np.ndarray, own: np.ndarray, new_ids: np.ndarray, new_scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of both: highest score, then smallest id; ``own`` marks what is of this shard."""
    ids, scores = np.concatenate([ids, new_ids]), np.concatenate([scores, new_scores])
    own = np.concatenate([own, np.ones(len(new_ids), bool)])
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best], own[best]


def _segments(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a batch in which no key changes."""
    n = len(keys[0])
    change = np.zeros(max(0, n - 1), bool)
    for x in keys:
        change |= x[1:] != x[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return zip(cuts[:-1], cuts[1:]) if n else iter(())


def _streamed(index: DataFrame, queries: DataFrame, number: str, count: int, answer, schema: str) -> DataFrame:
    """Queries streamed past the index rows of their ``number`` (0 to ``count`` - 1).

    ``answer(index rows, query rows)`` gets all index rows of one number, then batch after batch of
    queries, and yields record batches.
    """
    both = index.withColumn("kind", F.lit(0)).unionByName(queries.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    parts = max(1, min(count, 20_000))
    both = both.repartitionById(parts, (F.col(number) % parts).cast("int")).sortWithinPartitions(number, "kind")

    def run(batches):
        at, held = None, []
        for batch in batches:
            numbers, kinds = batch.column(number).to_numpy(), batch.column("kind").to_numpy()
            for s, e in _segments(numbers, kinds):
                piece = batch.slice(s, e - s)
                if kinds[s] == 0:
                    held = [*held, piece] if at == numbers[s] else [piece]
                    at = numbers[s]
                elif at == numbers[s]:
                    if isinstance(held, list):
                        held = answer(held)
                    yield from held(piece)

    return both.mapInArrow(run, schema)


def found(table: DataFrame, space: Space, every: int, k: int, key: str, vector: str) -> DataFrame:
    """query_id, q (which of several vectors of that id), vec_id, score and seen.

    For every query (key divisible by ``every``) and every shard that it visits one row with the
    rows verified there (``seen``, vec_id null), and rows with what was found (``seen`` null).
    """
    spark = table.sparkSession
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & valid(table.select(F.col(vector).alias("v")), "v", not space.zeros))
    rows = materialize(rows.dropDuplicates(["id", "v"]).withColumn("d", F.size("v")), "vectors")
    size = rows.agg(F.count("*"), F.max("d")).first()
    n, dim = size[0], max(1, size[1] or 1)
    sample_rows = max(64, SAMPLE_VALUES // dim)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()  # SAMPLE_VALUES values
    routers: dict[int, Router] = {}
    lengths = sample.column("d").to_numpy()
    enough = min(spark.sparkContext.defaultParallelism, -(-n // SHARD_ROWS))
    for d in np.unique(lengths):
        own = sample.filter(pa.array(lengths == d))
        share = n * own.num_rows / len(lengths)
        regions = min(max(-(-int(share * max(1, d)) // SHARD_VALUES), enough), max(1, own.num_rows // min(REGION_ROWS, LEAF)))
        routers[int(d)] = Router(space.rows(space.prepare(matrix(own.column("v"), own.num_rows))), int(regions))
    shared = spark.sparkContext.broadcast(routers)  # fewer nodes than the sample has rows, twice

    def route(batches):
        for batch in batches:
            d = batch.column("d").to_numpy()
            region = np.zeros(len(d), np.int64)
            for one in np.unique(d):
                at = np.flatnonzero(d == one)
                if int(one) in shared.value:
                    region[at] = shared.value[int(one)].assign(space.rows(space.prepare(matrix(batch.column("v").take(pa.array(at)), len(at)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], [*batch.schema.names, "region"])

    rows = materialize(rows.mapInArrow(route, rows.withColumn("region", F.lit(0).cast("long")).schema), "regions")
    # one row per region (bounded by the sample) and length of vectors
    counts = sorted((r["d"], r["region"], r["count"]) for r in rows.groupBy("d", "region").count().collect())
    places, total, groups, group = [], 0, {}, 0
    for d, region, c in counts:
        subs = -(-c * max(1, d) // (2 * SHARD_VALUES))
        if d not in groups:
            group = group if not groups else max(g for _, g in groups.values()) + 1
            groups[d] = (group, group)
            first = total
        places.append((d, region, subs, total, groups[d][0], first))
        total += subs
        groups[d] = (groups[d][0], groups[d][0] + (total - 1 - first) // BOX_GROUP)
    place = F.broadcast(spark.createDataFrame(places, "d int, region long, subs long, base long, group0 long, first long"))
    sub = F.pmod(F.xxhash64("id", "v"), F.col("subs"))
    rows = rows.join(place, ["d", "region"]).withColumn("shard", F.col("base") + sub)
    rows = rows.withColumn("grp", F.col("group0") + F.floor((F.col("shard") - F.col("first")) / BOX_GROUP)).select("shard", "grp", "d", "id", "v")

    parts = max(1, min(total, 20_000))
    placed = rows.repartitionById(parts, (F.col("shard") % parts).cast("int")).sortWithinPartitions("shard")

    def build(batches):
        def done(held):
            one = pa.Table.from_batches(held)
            s = Shard.build(space, one.column("id").to_numpy(), space.prepare(matrix(one.column("v"), one.num_rows)))
            head = [pa.array([one.column(c)[0].as_py()], pa.int64()) for c in ("shard", "grp")]
            return pa.RecordBatch.from_arrays([*head, *(pa.array([x], pa.binary()) for x in (*s.pack(), s.lo[0].tobytes(), s.hi[0].tobytes()))], ["shard", "grp", "ids", "points", "lo", "hi", "nodes", "low", "high"])

        held, at = [], None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            for s, e in _segments(numbers):
                if at is not None and at != numbers[s]:
                    yield done(held)
                    held = []
                at = numbers[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield done(held)

    index = materialize(placed.mapInArrow(build, f"shard bigint, grp bigint, {Shard.COLUMNS}, low binary, high binary"), "index")
    kind = pa.int64() if space.score_type == "bigint" else pa.float64()

    def answers(carry: bool):
        """Own shard: one row per query with its list; others: rows of what was found."""

        def opened(held):
            row = pa.Table.from_batches(held).select(["ids", "points", "lo", "hi", "nodes"]).to_pylist()[0]
            shard = Shard.unpack(space, *row.values())

            def batchwise(piece):
                ids, qs = piece.column("id").to_numpy(), space.prepare(matrix(piece.column("v"), piece.num_rows))
                if carry:
                    none = (np.zeros(0, np.int64), np.zeros(0, kind.to_pandas_dtype()))
                    kths, near = np.full(len(ids), -np.inf), [none] * len(ids)
                else:
                    kths = piece.column("kth").to_numpy()
                    near = [(np.array(a, np.int64), np.array(b, kind.to_pandas_dtype())) for a, b in zip(piece.column("near").to_pylist(), piece.column("scores").to_pylist())]
                out = list(space.search(shard, ids, qs, kths, near, k))
                if carry:
                    last = [float(s[-1]) if len(s) == k else -np.inf for _, s, _ in out]
                    extra = [pa.array(last, pa.float64()), pa.array([a.tolist() for a, _, _ in out], pa.list_(pa.int64())), pa.array([s.tolist() for _, s, _ in out], pa.list_(kind)), pa.array([c for _, _, c in out], pa.int64())]
                    names = ["shard", "grp", "d", "id", "q", "v"]
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), *extra], [*names, "kth", "near", "scores", "seen"])
                    return
                q = piece.column("q").to_numpy()
                lens = np.array([len(a) for a, _, _ in out], np.int64)
                best = pa.array(np.concatenate([a for a, _, _ in out]), pa.int64())
                score = pa.array(np.concatenate([s for _, s, _ in out]).astype(kind.to_pandas_dtype()), kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, lens)), pa.array(np.repeat(q, lens)), best, score, pa.nulls(len(best), pa.int64())], ["query_id", "q", "vec_id", "score", "seen"])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(q), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), kind), pa.array([c for _, _, c in out], pa.int64())], ["query_id", "q", "vec_id", "score", "seen"])

            return batchwise

        return opened

    queries = rows.filter(F.col("id") % every == 0).withColumn("q", F.xxhash64("id", "v"))
    vector_type = rows.schema["v"].dataType.simpleString()
    asked = f"shard bigint, grp bigint, d int, id bigint, q bigint, v {vector_type}, kth double, near array<bigint>, scores array<{space.score_type}>, seen bigint"
    home = materialize(_streamed(index.select("shard", *(c.split()[0] for c in Shard.COLUMNS.split(", "))), queries, "shard", total, answers(True), asked), "home")

    # which other shards: the boxes of a group of shards, past which a block of queries streams
    blocks = max(1, -(-home.count() // ROUTED))
    of_length = F.broadcast(spark.createDataFrame([(d, a, b) for d, (a, b) in groups.items()] or [(-1, 0, 0)], "d int, g0 long, g1 long"))
    block = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    boxes = index.select(F.col("shard").alias("box"), "grp", "low", "high").withColumn("c", F.explode(block)).withColumn("no", F.col("grp") * blocks + F.col("c")).drop("c", "grp")
    asks = home.drop("grp", "seen").join(of_length, "d").withColumn("g", F.explode(F.sequence("g0", "g1"))).withColumn("no", F.col("g") * blocks + F.pmod(F.xxhash64("q"), F.lit(blocks))).drop("g0", "g1", "g")

    def routed(held):
        boxes_ = pa.Table.from_batches(held)
        numbers = boxes_.column("box").to_numpy()
        lo, hi = (np.stack([np.frombuffer(x) for x in boxes_.column(c).to_pylist()]) for c in ("low", "high"))

        def batchwise(piece):
            names = ["d", "id", "q", "v", "kth", "near", "scores"]
            for s in range(0, piece.num_rows, 256):
                part = piece.slice(s, 256)
                go = space.reach(lo, hi, space.prepare(matrix(part.column("v"), part.num_rows)), part.column("kth").to_numpy())
                go &= numbers[None, :] != part.column("shard").to_numpy()[:, None]
                who, where = np.nonzero(go)
                for a in range(0, len(who), 8192):
                    rows_ = part.take(pa.array(who[a : a + 8192]))
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[where[a : a + 8192]]), *(rows_.column(c) for c in names)], ["shard", *names])

        return batchwise

    kept = f"shard bigint, d int, id bigint, q bigint, v {vector_type}, kth double, near array<bigint>, scores array<{space.score_type}>"
    last_group = max((b for _, b in groups.values()), default=0)
    onward = _streamed(boxes, asks, "no", (last_group + 1) * blocks, routed, kept)
    others = _streamed(index.select("shard", *(c.split()[0] for c in Shard.COLUMNS.split(", "))), onward, "shard", total, answers(False), f"query_id bigint, q bigint, vec_id bigint, score {space.score_type}, seen bigint")
    pair = F.explode(F.arrays_zip("near", "scores"))
    own = home.select(F.col("id").alias("query_id"), "q", pair.alias("_p")).select("query_id", "q", F.col("_p")["near"].alias("vec_id"), F.col("_p")["scores"].alias("score"), F.lit(None).cast("long").alias("seen"))
    counted = home.select(F.col("id").alias("query_id"), "q", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast(space.score_type).alias("score"), "seen")
    return others.unionAll(own).unionAll(counted)


def search(table: DataFrame, space: Space, every: int, k: int, key: str, vector: str) -> DataFrame:
    """query_id, rank, vec_id and score for queries whose key is divisible by ``every``.

    Rows equal in key and vector count once; vectors only meet those of their own length. Null keys
    take no part. Ties go to the smaller key.
    """
    hits = found(table, space, every, k, key, vector).filter(F.col("vec_id").isNotNull())
    w = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def verified(table: DataFrame, space: Space, every: int, k: int, key: str, vector: str) -> DataFrame:
    """One row: queries, shards visited a query, and rows verified a query."""
    seen = found(table, space, every, k, key, vector).filter(F.col("seen").isNotNull()).groupBy("query_id", "q").agg(F.count("*").alias("n"), F.sum("seen").alias("s"))
    return seen.agg(F.count("*").alias("queries"), F.avg("n").alias("shards"), F.avg("s").alias("rows"))


def frame(ids: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
    """For tests: a table of vectors."""
    return pd.DataFrame({"vec_id": ids, "embedding": list(vectors)})
