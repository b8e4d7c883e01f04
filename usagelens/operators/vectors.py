"""Nearest vectors, exactly: a few queries by scans of the table, many by lists around centres.

`VectorLists` keeps a table as lists of the vectors nearest to each of some
centres, with their distance from it. A query looks into the lists around it
first; the distance of its k-th found bounds where nearer ones can lie: by the
triangle inequality a list can only hold one if its centre is not further than
the bound and the list's radius together, and a member only if its distance from
the centre differs from the query's by no more than the bound. Where that keeps
nothing apart, every query meets every member: the work is quadratic then, what
is shuffled is not, since queries meet members on a grid of fixed size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.session import materialise

# The Arrow functions below travel to the workers by value, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_BLOCK = 1_000
#: Shelves that the lists of a table are dealt over, and parts that the visits to one are dealt over: both stay while tables grow.
SHELVES = 8
#: Members of a shelf, or queries of a part, that a task holds at most before their number grows; visits that are worth a part of their own.
LIST_PART, QUERY_PART = 131_072, 1_024
#: Queries and members whose distances are worked out at once, and pairs whose exact ones are.
SEARCH_BLOCK, CHUNK, PAIRS = 256, 2_048, 65_536


def _exact(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.square(vectors - queries).sum(axis=-1)
    return -(vectors * queries).sum(axis=-1)


def _search(query_ids: list, queries: np.ndarray, k: int, metric: str):
    """The k nearest of each Arrow batch to each query of a block: a matrix product picks, exact distances decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            table = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            rough = -(queries @ table.T)
            if metric == "l2":
                rough = 2 * rough + np.square(table).sum(axis=1) + np.square(queries).sum(axis=1)[:, None]
            last = min(k, len(ids)) - 1
            limit = np.partition(rough, last, axis=1)[:, last]
            q, v = np.nonzero(rough <= (limit + 1e-9 * np.maximum(1.0, np.abs(limit)))[:, None])
            distance = _exact(table[v], queries[q], metric)
            order = np.lexsort((ids[v], distance, q))
            q, v, distance = q[order], v[order], distance[order]
            near = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield pa.RecordBatch.from_arrays(
                [pa.array([query_ids[i] for i in q[near]], pa.int64()), pa.array(ids[v[near]]), pa.array(distance[near])], ["q", "v", "distance"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", query_vec: str = "query",
            id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """The k nearest vectors of every query, by squared distance or dot product; ids are integers.

    Queries go out in blocks of QUERY_BLOCK, one scan of the table each; a task
    keeps k rows per query and batch, and only those are shuffled.
    """
    queries = materialise(queries.select(query_id, query_vec), "vector-queries")  # read by every block
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(query_id)) - 1
    placed = queries.select(F.col(query_id).cast("long").alias(query_id), F.col(query_vec).cast("array<double>").alias("_q")).withColumn(
        "_part", F.pmod(F.xxhash64(query_id), F.lit(parts))).withColumn("_block", F.floor(place / QUERY_BLOCK))
    source = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias("_v"))
    found = source.limit(0).select(F.col(id_col).alias("q"), F.col(id_col).alias("v"), F.lit(0.0).alias("distance"))
    for block in placed.select("_part", "_block").distinct().orderBy("_part", "_block").collect():
        asked = placed.filter((F.col("_part") == block["_part"]) & (F.col("_block") == block["_block"])).collect()
        matrix = np.array([r["_q"] for r in asked], dtype=np.float64)
        found = found.unionByName(source.mapInArrow(
            _search([r[query_id] for r in asked], matrix, k, metric), "q long, v long, distance double"))
    order = Window.partitionBy(query_id).orderBy("distance", id_col)
    return found.withColumnsRenamed({"q": query_id, "v": id_col}).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# ------------------------------------------------------------------------ lists
def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _rough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows by a matrix product: near enough to choose by, with `_slack`."""
    return np.maximum(np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1) - 2 * (a @ b.T), 0.0)


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """What a squared distance by matrix product may be off."""
    return 1e-12 * (a.shape[1] + 8) * float(np.square(a).sum(axis=1).max(initial=0.0) + np.square(b).sum(axis=1).max(initial=0.0))


def _centres(rows: DataFrame, n: int, rounds: int) -> np.ndarray:
    """At most `n` centres, from rows chosen by hash and moved to their list's mean `rounds` times; n vectors come to the driver."""
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(n).select("v").toPandas()
    centres = np.unique(np.array(chosen["v"].tolist(), dtype=np.float64), axis=0) if len(chosen) else np.zeros((0, 0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros_like(centres), np.zeros(len(centres), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                table = _matrix(batch.column(0))
                best = _rough(table, centres).argmin(axis=1)
                np.add.at(total, best, table)
                number += np.bincount(best, minlength=len(centres))
        seen = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(number[seen]), pa.array(list(total[seen]), pa.list_(pa.float64()))], ["list", "n", "s"])

    for _ in range(rounds if len(centres) else 0):
        parts = rows.select("v").mapInArrow(sums, "list int, n long, s array<double>")
        means = parts.select("list", "n", F.posexplode("s").alias("i", "x")).groupBy("list", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
        moved = means.groupBy("list").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v")).orderBy("list").toPandas()
        centres = np.array(moved["v"].tolist(), dtype=np.float64)
    return centres


class VectorLists:
    """A table of vectors (integer ids, squared distances) in lists under a folder that all executors reach.

    Vectors that are null, or hold a null or non-finite component, or are of
    another length than the centres, take no part.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int = 256, rounds: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorLists:
        """Lists around at most `lists` centres."""
        self = cls(vectors.sparkSession, path)
        rows = materialise(self._clean(vectors, id_col, vec_col), "vectors")
        width = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
        rows = rows.filter(F.size("v") == (width[0]["w"] if width else 0))
        centres = _centres(rows, lists, rounds)
        kept = pa.table({"list": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(list(centres), pa.list_(pa.float64()))})
        self.spark.createDataFrame(kept).coalesce(1).write.parquet(f"{path}/centres")
        self._assigned(rows, centres).write.parquet(f"{path}/members")
        return self

    def add(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        """Put vectors with new ids into their lists; of rows with one new id one is kept."""
        fresh = self._clean(vectors, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
        fresh = materialise(fresh.join(self.members().select("id"), "id", "left_anti"), "vectors-new")
        self._assigned(fresh, self.centres()).write.mode("append").parquet(f"{self.path}/members")

    def members(self) -> DataFrame:
        """list, id, v, away (distance from the list's centre)."""
        return self.spark.read.schema("list int, id long, v array<double>, away double").parquet(f"{self.path}/members")

    def centres(self) -> np.ndarray:
        rows = self.spark.read.schema("list int, centre array<double>").parquet(f"{self.path}/centres").orderBy("list").toPandas()
        return np.array(rows["centre"].tolist(), dtype=np.float64) if len(rows) else np.zeros((0, 0))

    @staticmethod
    def _clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        return rows.filter(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))

    @staticmethod
    def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(np.diff(batch.column(1).offsets.to_numpy()) == centres.shape[1]))
                if batch.num_rows:
                    table = _matrix(batch.column(1))
                    best = _rough(table, centres).argmin(axis=1)
                    away = np.sqrt(np.square(table - centres[best]).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), batch.column(0), batch.column(1), pa.array(away)], ["list", "id", "v", "away"])

        return rows.select("id", "v").mapInArrow(run, "list int, id long, v array<double>, away double")

    def nearest(self, queries: DataFrame, k: int, query_id: str = "query_id", query_vec: str = "query", others_only: bool = False) -> DataFrame:
        """(query, vec_id, distance, rank): the k nearest members of every query, equal distances by id; `others_only` leaves out the query's own id.

        Queries stay distributed. They visit the shelves with the lists around them
        until those hold k members (and the own one), then every shelf with a list
        that may hold a nearer one. A query is sent to a shelf once, a member once
        for each part of the shelf's visits, and neither number grows with the table
        below SHELVES x LIST_PART members or as many queries.
        """
        centres, need = self.centres(), k + others_only
        sizes = self.members().groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("list").toPandas()
        number, radius = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres))
        number[sizes["list"]], radius[sizes["list"]] = sizes["n"], sizes["radius"]
        first_shelf, shelf_parts = shelves(number)
        n_shelves = int((first_shelf + shelf_parts).max(initial=1))
        holds = np.zeros((len(centres), n_shelves), dtype=bool)  # which lists a shelf has
        for i in np.flatnonzero(number):
            holds[i, first_shelf[i]:first_shelf[i] + shelf_parts[i]] = True
        asked = materialise(self._clean(queries, query_id, query_vec).filter(F.size("v") == (centres.shape[1] if len(centres) else 0)), "vector-queries")

        def visits(first: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    far = np.sqrt(_rough(table := _matrix(batch.column(1)), centres))
                    slack = np.sqrt(_slack(table, centres))
                    order = np.argsort(far, axis=1, kind="stable")
                    before = np.cumsum(number[order], axis=1) - number[order]
                    home = np.zeros(far.shape, dtype=bool)
                    np.put_along_axis(home, order, before < need, axis=1)
                    wanted = home @ holds
                    bound = np.full(batch.num_rows, np.inf) if first else batch.column(2).to_numpy(zero_copy_only=False)
                    if not first:
                        wanted = (far - radius <= bound[:, None] + slack) @ holds & ~wanted
                    q, to = np.nonzero(wanted)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(to, pa.int32()), batch.column(0).take(pa.array(q)), batch.column(1).take(pa.array(q)), pa.array(bound[q] + slack)],
                        ["shelf", "q", "qv", "bound"])

            return run

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            return _nearest_members(left.combine_chunks(), right.combine_chunks(), centres, need)

        def by_list(values: np.ndarray):
            return F.array(*[F.lit(int(x)) for x in values])[F.col("list")] if len(values) else F.lit(1)

        members = self.members().withColumn("shelf", (by_list(first_shelf) + F.pmod(F.xxhash64("id"), by_list(shelf_parts))).cast("int"))
        visit, found_as = "shelf int, q long, qv array<double>, bound double", "q long, id long, distance double"

        def found(probes: DataFrame) -> DataFrame:
            probes = materialise(probes, "vector-visits")
            visitors = {r["shelf"]: r["n"] for r in probes.groupBy("shelf").agg(F.count("*").alias("n")).collect()}
            qparts = F.array(*[F.lit(query_parts(visitors.get(i, 0))) for i in range(n_shelves)])[F.col("shelf")]
            dealt = probes.withColumn("qpart", F.pmod(F.xxhash64("q"), qparts).cast("int"))
            table = members.filter(qparts > 0).withColumn("qpart", F.explode(F.sequence(F.lit(0), qparts - 1)))
            table = table.select("list", "id", "v", "away", F.col("shelf").alias("_shelf"), F.col("qpart").alias("_qpart"))
            return dealt.groupBy("shelf", "qpart").cogroup(table.groupBy("_shelf", "_qpart")).applyInArrow(meet, found_as)

        order = Window.partitionBy("q").orderBy("distance", "id")

        def best(rows: DataFrame) -> DataFrame:
            rows = rows.filter("q <> id") if others_only else rows
            return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        home = materialise(best(found(asked.select("id", "v").mapInArrow(visits(True), visit))), "vectors-home")
        # Without k members so far, everything is near enough.
        bounds = home.groupBy("q").agg(F.when(F.count("*") == k, F.sqrt(F.max("distance"))).otherwise(F.lit(float("inf"))).alias("bound"))
        bounded = asked.join(bounds, asked["id"] == bounds["q"], "left").select("id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        further = found(bounded.mapInArrow(visits(False), visit))
        both = best(home.select("q", "id", "distance").unionByName(further))
        return both.select(F.col("q").alias(query_id), F.col("id").alias("vec_id"), "distance", "rank")


def shelves(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shelf of each list, and over how many it is dealt: lists follow each other on SHELVES shelves, or more where LIST_PART asks for it."""
    total = int(number.sum())
    size = max(1, -(-total // max(SHELVES, -(-total // LIST_PART))))
    parts = np.maximum(-(-number // size), 1)
    before = np.cumsum(number) - number
    # A list that fits goes whole where its middle lies; a longer one begins where it begins.
    return np.where(parts == 1, before + number // 2, before) // size, parts


def query_parts(visits: int) -> int:
    """Into how many parts the visits to a shelf are dealt, each of which gets the shelf's members."""
    return max(min(-(-visits // QUERY_PART), SHELVES), -(-visits // LIST_PART))


def _few_copies(members: pa.Table, k: int) -> pa.Table:
    """Members by list and distance from its centre; of equal vectors only the k smallest ids, since no other is among the k nearest."""
    table = _matrix(members.column("v").chunk(0))
    _, same = np.unique(np.ascontiguousarray(table).view(f"V{table.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.lexsort((members.column("id").to_numpy(), same))
    kept = order[np.arange(len(order)) - np.searchsorted(same[order], same[order]) < k]
    kept = kept[np.lexsort((members.column("away").to_numpy()[kept], members.column("list").to_numpy()[kept]))]
    return members.take(pa.array(kept)).combine_chunks()


def _nearest_members(probes: pa.Table, members: pa.Table, centres: np.ndarray, k: int) -> pa.Table:
    """The k nearest of a shelf's members to each probe, as far as its bound; distances are exact."""
    nothing = np.zeros(0, dtype=np.int64)
    out = [(nothing, nothing, np.zeros(0))]
    if probes.num_rows and members.num_rows:
        members = _few_copies(members, k)
        table, ids, lists, away = _matrix(members.column("v").chunk(0)), *(members.column(c).to_numpy() for c in ("id", "list", "away"))
        queries, asked, bound = _matrix(probes.column("qv").chunk(0)), probes.column("q").to_numpy(), probes.column("bound").to_numpy()
        sums = np.column_stack([table, np.ones(len(table)), np.square(table).sum(axis=1)])
        cuts = np.flatnonzero(np.diff(lists)) + 1
        chunks = {int(lists[low]): [(at, min(at + CHUNK, high)) for at in range(low, high, CHUNK)]
                  for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lists)])}
        # Queries around one centre are searched together.
        by_place = np.argsort(_rough(queries, centres).argmin(axis=1), kind="stable")
        for at in range(0, len(by_place), SEARCH_BLOCK):
            some = by_place[at:at + SEARCH_BLOCK]
            q, v, distance = _nearest_in_chunks(queries[some], bound[some], table, sums, ids, away, centres, chunks, k)
            out.append((asked[some[q]], ids[v], distance))
    q, v, distance = map(np.concatenate, zip(*out))
    return pa.table({"q": pa.array(q, pa.int64()), "id": pa.array(v, pa.int64()), "distance": pa.array(distance, pa.float64())})


def _nearest_in_chunks(queries: np.ndarray, bound: np.ndarray, table: np.ndarray, sums: np.ndarray, ids: np.ndarray, away: np.ndarray,
                       centres: np.ndarray, chunks: dict[int, list[tuple[int, int]]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, distance) for a block of queries, nearer lists first; what is found narrows what later chunks must hold."""
    far, slack = np.sqrt(_rough(queries, centres)), _slack(queries, table) + _slack(queries, centres)
    limit = np.square(bound)
    q, v, distance = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    # |q|^2 + |v|^2 - 2qv as one product, into the same memory for every chunk.
    factors, held = np.column_stack([-2 * queries, np.square(queries).sum(axis=1), np.ones(len(queries))]), np.empty(len(queries) * CHUNK)
    for i in sorted(chunks, key=lambda i: far[:, i].mean()):
        for low, high in chunks[i]:
            # The triangle inequality: members between two distances from the centre.
            reach = np.sqrt(limit) + 2 * np.sqrt(slack)
            at = np.flatnonzero((far[:, i] - away[high - 1] <= reach) & (away[low] - far[:, i] <= reach))
            if not len(at):
                continue
            rough = np.matmul(factors[at], sums[low:high].T, out=held[:len(at) * (high - low)].reshape(len(at), high - low))
            top = limit[at]
            if high - low >= k and len(open_at := np.flatnonzero(np.isinf(top))):
                top[open_at] = np.partition(rough[open_at], k - 1, axis=1)[:, k - 1] + slack
            near_q, near_v = np.divmod(np.flatnonzero(rough <= (top + slack)[:, None]), high - low)
            if not len(near_q):
                continue
            near_q, near_v = at[near_q], near_v + low
            parts = [np.square(table[near_v[p:p + PAIRS]] - queries[near_q[p:p + PAIRS]]).sum(axis=1) for p in range(0, len(near_q), PAIRS)]
            q, v, distance = np.concatenate([q, near_q]), np.concatenate([v, near_v]), np.concatenate([distance, *parts])
            order = np.lexsort((ids[v], distance, q))
            order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
            q, v, distance = q[order], v[order], distance[order]
            full = np.flatnonzero(np.bincount(q, minlength=len(queries)) == k)
            limit[full] = np.minimum(limit[full], distance[np.searchsorted(q, full, side="right") - 1])
    return q, v, distance


def centroids(vectors: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """The mean vector of each group."""
    each = vectors.select(group_col, F.posexplode(F.col(vec_col).cast("array<double>")).alias("_i", "_x"))
    means = each.groupBy(group_col, "_i").agg(F.avg("_x").alias("_x"))
    return means.groupBy(group_col).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("centroid"))


def add_vectors(stored: DataFrame, fresh: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Add vectors whose id is not stored yet."""
    known = stored.select(id_col)
    return stored.unionByName(fresh.dropDuplicates([id_col]).join(known, id_col, "left_anti"))
