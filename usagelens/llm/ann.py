"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Equal vectors fold to one node first (a row's nearest can only be the K smallest
ids of a node, so no more are carried). The graph starts from blocks of nodes
that lie together on random directions. A round of NN-descent sends every node,
with its vector, to the nodes it neighbours, either way; whoever meets there and
is new to one another is compared, and each node keeps its best NEIGHBOURS. Each
round is a join, a shuffle by meeting place and a merge; vectors travel as half
precision. Reverse neighbours are a fresh sample of at most REVERSE a round, as
usual for NN-descent, which bounds a meeting whatever the hub.

A query starts from its own node's neighbours and opens its WIDTH best unopened
nodes a round; the neighbour lists stand, with vectors, in a bucketed table, so
only (query, node) pairs move. Survivors are scored again in double precision on
the original vectors. Work grows with rows and queries, not with their product.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.llm.common import attach_by_key, whole_groups
from usagelens.session import materialise, scratch_path

NEIGHBOURS, REVERSE, ROUNDS, PER_MEETING, SETTLED = 24, 16, 7, 6, 0.02
DIRECTIONS, BLOCK = 2, 64
WIDTH, POOL, HOPS, FINAL = 80, 640, 9, 48
LISTS = "owner long, ids array<long>, scores array<float>, flags array<tinyint>"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a round go when its result is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part: finite, not zero, of the table's most common length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("vec_id is not null")
    rows = rows.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("vec") == (common["n"] if common else 0))


def _halves(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16).reshape(len(column), -1).astype(np.float32)


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, vec, half, d0, d1, ...): one row per distinct vector, its unit vector in half precision and its place on random directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            lines = np.random.RandomState(5).randn(v.shape[1], DIRECTIONS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary()),
                                              *[pa.array(c) for c in (v @ lines).T]], ["node", "vec", "half", *[f"d{i}" for i in range(DIRECTIONS)]])

    return rows.mapInArrow(run, "node long, vec array<double>, half binary, " + ", ".join(f"d{i} double" for i in range(DIRECTIONS)))


def _lists(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    """Entries sorted by owner, packed to one row per run of an owner."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=np.int64)
    ends = pa.array(np.r_[starts, len(owner)].astype(np.int32))
    made = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids.astype(np.int64), scores.astype(np.float32), flags.astype(np.int8))]
    return pa.RecordBatch.from_arrays([pa.array(owner[starts].astype(np.int64)), *made], ["owner", "ids", "scores", "flags"])


def _best_of(product: np.ndarray, member: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(meeting, member, partner) places of each member's best partners; -9 marks pairs out of question."""
    if product.shape[2] > most:
        top = np.argpartition(-product, most - 1, axis=2)[:, :, :most]
    else:
        top = np.broadcast_to(np.arange(product.shape[2]), product.shape)
    g, i, j = np.nonzero(np.take_along_axis(product, top, 2) > -8)
    return g, i, top[g, i, j]


def _first_blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, v = b.column(0).to_numpy(), _halves(b.column(1))
            for at in range(0, len(node), BLOCK):
                ids, x = node[at:at + BLOCK], v[at:at + BLOCK]
                product = (x @ x.T)[None]
                product[0][np.eye(len(ids), dtype=bool)] = -9
                _, i, j = _best_of(product, ids, most)
                yield _lists(ids[i], ids[j], product[0, i, j], np.ones(len(i)))

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the members of each meeting place; rows (center, member, fresh, least, half) sorted by center."""
    for b in whole_groups(batches):
        center, member, fresh, least = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        begins = np.flatnonzero(np.r_[True, center[1:] != center[:-1]])
        sizes = np.diff(np.r_[begins, len(center)])
        half = b.column(4)
        for a in range(0, len(begins), 256):
            lo, hi = begins[a], begins[min(a + 256, len(begins)) - 1] + sizes[min(a + 256, len(begins)) - 1]
            n = sizes[a:a + 256]
            g, p = np.repeat(np.arange(len(n)), n), np.arange(hi - lo) - np.repeat(begins[a:a + 256] - lo, n)
            v = _halves(half.slice(lo, hi - lo))
            shape = (len(n), int(n.max()))
            who, new, floor = np.full(shape, -1), np.zeros(shape, bool), np.full(shape, 9.0, dtype=np.float32)
            who[g, p], new[g, p], floor[g, p] = member[lo:hi], fresh[lo:hi] > 0, least[lo:hi]
            there = np.zeros(shape, bool)
            there[g, p] = True
            full = np.zeros((*shape, v.shape[1]), dtype=np.float32)
            full[g, p] = v
            product = full @ full.transpose(0, 2, 1)
            skip = (who[:, :, None] == who[:, None, :]) | ~(new[:, :, None] | new[:, None, :]) | ~there[:, None, :] | (product <= floor[:, :, None])
            product[skip] = -9
            g, i, j = _best_of(product, who, PER_MEETING)
            yield _lists(who[g, i], who[g, j], product[g, i, j], np.ones(len(g)))


def _merge(most: int, width: int = 0):
    """Each owner's best `most` entries; an id that comes twice keeps its smaller flag. With `width`, its first waiting entries (flag 2) become 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            count = np.diff(b.column(1).offsets.to_numpy())
            owner = np.repeat(b.column(0).to_numpy(), count)
            ids, scores, flags = (b.column(c).flatten().to_numpy() for c in (1, 2, 3))
            order = np.lexsort((flags, ids, owner))
            owner, ids, scores, flags = owner[order], ids[order], scores[order], flags[order]
            once = np.r_[True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])][:len(owner)] & (ids != owner)
            owner, ids, scores, flags = owner[once], ids[once], scores[once], flags[once]
            order = np.lexsort((ids, -scores, owner))
            owner, ids, scores, flags = owner[order], ids[order], scores[order], flags[order].copy()
            keep = _place(owner) < most
            owner, ids, scores, flags = owner[keep], ids[keep], scores[keep], flags[keep]
            if width:
                waiting = np.flatnonzero(flags == 2)
                flags[waiting[_place(owner[waiting]) < width]] = 1
            yield _lists(owner, ids, scores, flags)

    return run


def _place(owner: np.ndarray) -> np.ndarray:
    """The number of each entry within its run of one owner."""
    begins = np.r_[True, owner[1:] != owner[:-1]][:len(owner)]
    return np.arange(len(owner)) - np.maximum.accumulate(np.where(begins, np.arange(len(owner)), 0)) if len(owner) else owner


def _merged(lists: DataFrame, most: int, label: str, width: int = 0) -> DataFrame:
    ready = lists.select("owner", "ids", "scores", "flags").repartition("owner").sortWithinPartitions("owner")
    return materialise(ready.mapInArrow(_merge(most, width), LISTS), label)


def _flagged(lists: DataFrame, was: int, now: int) -> DataFrame:
    return lists.withColumn("flags", F.transform("flags", lambda f: F.when(f == was, F.lit(now).cast("tinyint")).otherwise(f)))


def build_graph(nodes: DataFrame, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """NN-descent: (owner, ids, scores, flags), best first."""
    starts = None
    for d in range(DIRECTIONS):
        laid = nodes.select("node", "half", f"d{d}").repartitionByRange(f"d{d}", "node").sortWithinPartitions(f"d{d}", "node").select("node", "half")
        block = laid.mapInArrow(_first_blocks(neighbours), LISTS)
        starts = block if starts is None else starts.unionByName(block)
    graph = _merged(starts, neighbours, "ann-graph")
    total = graph.count() * neighbours
    for turn in range(rounds):
        edges = graph.select("owner", F.inline(F.arrays_zip("ids", "flags"))).withColumnsRenamed({"ids": "id", "flags": "fresh"})
        pick = Window.partitionBy("id").orderBy(F.xxhash64("owner", "id", F.lit(turn)), "owner")
        reverse = edges.withColumn("_n", F.row_number().over(pick)).filter(F.col("_n") <= REVERSE).select(
            F.col("id").alias("center"), F.col("owner").alias("member"), "fresh")
        members = edges.select(F.col("owner").alias("center"), F.col("id").alias("member"), "fresh").unionByName(reverse)
        least = graph.select(F.col("owner").alias("node"), F.when(F.size("scores") >= neighbours, F.element_at("scores", -1)).otherwise(-2.0).cast("float").alias("least"))
        known = nodes.select("node", "half").join(least, "node")
        sent = members.join(known, F.col("member") == F.col("node")).select("center", "member", F.col("fresh").cast("int").alias("fresh"), "least", "half")
        news = sent.repartition("center").sortWithinPartitions("center").mapInArrow(_meet, LISTS)
        graph = _merged(_flagged(graph, 1, 0).unionByName(news), neighbours, "ann-graph")
        changed = graph.agg(F.coalesce(F.sum(F.size(F.filter("flags", lambda f: f == 1))), F.lit(0))).first()[0]
        if changed <= SETTLED * total:
            break
    return graph


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of an opened node's neighbours: rows (owner, asked, least, ids, halves)."""
    for b in batches:
        if not b.num_rows:
            continue
        count = np.diff(b.column(3).offsets.to_numpy())
        asked = np.repeat(_halves(b.column(1)), count, axis=0)
        near = np.frombuffer(b"".join(b.column(4).to_pylist()), dtype=np.float16).reshape(len(asked), -1).astype(np.float32)
        scores = np.einsum("ij,ij->i", asked, near)
        keep = scores > np.repeat(b.column(2).to_numpy(), count)
        owner = np.repeat(b.column(0).to_numpy(), count)[keep]
        yield _lists(owner, b.column(3).flatten().to_numpy()[keep], scores[keep], np.full(len(owner), 2))


def _adjacency(spark: SparkSession, graph: DataFrame, nodes: DataFrame) -> str:
    """A bucketed table (node, near, halves) in the shared folder; returns its name."""
    edges = graph.select(F.col("owner"), F.posexplode("ids").alias("at", "id"))
    full = edges.join(nodes.select(F.col("node").alias("id"), "half"), "id").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("at", "id", "half"))).alias("x"))
    packed = full.select(F.col("owner").alias("node"), F.col("x.id").alias("near"), F.aggregate(F.col("x.half"), F.lit(b""), lambda s, h: F.concat(s, h)).alias("halves"))
    name, buckets = f"ann_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.repartition(buckets, "node").write.bucketBy(buckets, "node").option("path", scratch_path(spark, "ann-near")).saveAsTable(name)
    return name


def search(asked: DataFrame, graph: DataFrame, nodes: DataFrame, width: int = WIDTH, pool: int = POOL, hops: int = HOPS) -> DataFrame:
    """(owner, id, score) for each node in `asked`: its FINAL best nodes found, by greedy search from its own neighbours."""
    spark = nodes.sparkSession
    name = _adjacency(spark, graph, nodes)
    known = materialise(nodes.join(asked, "node", "left_semi").select(F.col("node").alias("q"), "half"), "ann-asked")
    state = graph.join(known, F.col("owner") == F.col("q"), "left_semi").withColumn("flags", F.transform("flags", lambda f: F.lit(2).cast("tinyint")))
    state = _merged(state, pool, "ann-state", width)
    for _ in range(hops):
        front = state.select("owner", F.when(F.size("scores") >= pool, F.element_at("scores", -1)).otherwise(-2.0).cast("float").alias("least"),
                             F.inline(F.arrays_zip("ids", "flags"))).filter("flags = 1")
        front = front.join(known, F.col("owner") == F.col("q")).select("owner", F.col("half").alias("asked"), "least", F.col("ids").alias("node"))
        if front.isEmpty():
            break
        opened = front.hint("shuffle_hash").join(spark.table(name), "node").select("owner", "asked", "least", "near", "halves")
        state = _merged(_flagged(state, 1, 0).unionByName(opened.mapInArrow(_open, LISTS)), pool, "ann-state", width)
    found = materialise(state.select("owner", F.slice("ids", 1, FINAL).alias("ids")).select("owner", F.explode("ids").alias("id")), "ann-found")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return found


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: str, b: str):
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that `is_query` (a condition on vec_id) picks.

    Cosine in double precision on the original vectors, ties to the smaller id,
    never the query's own id; fewer rows where there are fewer. Vectors that are
    null, zero, hold null or non-finite parts, or have another length than most
    take no part, nor do rows without id. Rows that repeat an id and its vector count once.
    """
    spark = vectors.sparkSession
    with short_lived_shuffles(spark):
        rows = materialise(usable(vectors, id_col, vec_col).distinct(), "ann-rows")
        few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
        few = materialise(few, "ann-few")
        nodes = materialise(_nodes(few.filter("_n = 1").select("vec_id", "vec")), "ann-nodes")
        node_of = nodes.select("node", F.col("vec").alias("_vec"))
        copies = materialise(few.join(node_of, F.col("vec") == F.col("_vec")).select("node", "vec_id"), "ann-copies")
        queries = materialise(attach_by_key(rows.filter(is_query), node_of.select("node", F.col("_vec").alias("vec")), "vec", "vec_id").select("vec_id", "node"), "ann-queries")
        asked = queries.select("node").distinct()
        graph = build_graph(nodes)
        found = search(asked, graph, nodes).unionByName(asked.select(F.col("node").alias("owner"), F.col("node").alias("id")))
        own, other = nodes.select(F.col("node").alias("owner"), F.col("vec").alias("_a")), nodes.select(F.col("node").alias("id"), F.col("vec").alias("_b"))
        scored = found.join(other, "id").join(own, "owner").select("owner", "id", cosine("_a", "_b").alias("score"))
        order = Window.partitionBy("owner").orderBy(F.desc("score"), "vec_id")
        best = scored.join(copies.withColumnRenamed("node", "id"), "id").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
        best = materialise(best.groupBy(F.col("owner").alias("node")).agg(F.collect_list(F.struct(F.negate("score").alias("s"), F.col("vec_id").alias("v"))).alias("best")), "ann-best")
    each = attach_by_key(queries, best, "node", "vec_id")
    left = F.slice(F.array_sort(F.filter("best", lambda x: x["v"] != F.col("vec_id"))), 1, k)
    return each.select(F.col("vec_id").alias("query_id"), F.posexplode(left).alias("_at", "_x")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_x.v").alias("vec_id"), F.negate("_x.s").alias("score"))
