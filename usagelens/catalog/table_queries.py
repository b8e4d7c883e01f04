"""Keyed writes, comparisons, row operations and the entity graph over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.catalog import projections as p
from usagelens.catalog.registry import query
from usagelens.operators import graph, rows, tables
from usagelens.operators.keyed_log import KeyedLog
from usagelens.session import scratch_path
from usagelens.sources import generic


def _versions(spark, folder):
    """Two versions of an order list: stored rows, and later corrections of every third one plus new keys."""
    orders = p.table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS customer", "o_totalprice AS price", "o_orderstatus AS status", "0 AS seq")
    stored = orders.filter("id % 4 <> 3")
    updates = orders.filter("id % 3 = 0 OR id % 4 = 3").selectExpr(
        "id", "customer", "price + 1 AS price", "'U' AS status", "explode(array(1, 2)) AS seq").selectExpr(
        "id", "customer", "price + seq AS price", "status", "seq")
    return stored, updates


@query("upsert_latest", """SELECT o_orderkey AS id, o_custkey AS customer,
  CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 3 THEN round(o_totalprice + 3, 2) ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 3 THEN 'U' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 3 THEN 2 ELSE 0 END AS seq FROM orders""")
def upsert_latest(spark, folder):
    stored, updates = _versions(spark, folder)
    return tables.upsert(stored, updates, ["id"], ["seq"]).withColumn("price", F.round("price", 2))


@query("upsert_keeps_creation", """SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END AS seq, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 3 THEN 'U' ELSE o_orderstatus END AS status FROM orders""")
def upsert_keeps_creation(spark, folder):
    stored, updates = _versions(spark, folder)
    return tables.upsert(stored, updates, ["id"], ["seq"], keep_first=("seq",)).select("id", "seq", "status")


@query("partial_upsert", """SELECT o_orderkey AS id, o_custkey AS customer,
  CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 3 THEN round(o_totalprice + 3, 2) ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 4 = 3 THEN 'U' ELSE o_orderstatus END AS status FROM orders""")
def partial_upsert(spark, folder):
    stored, updates = _versions(spark, folder)
    latest = tables.latest_per_key(updates, ["id"], ["seq"])
    return tables.upsert_columns(stored, latest, "id", ["price"]).select(
        "id", "customer", F.round("price", 2).alias("price"), "status")


@query("append_new", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 3")
def append_new(spark, folder):
    stored, updates = _versions(spark, folder)
    return tables.new_rows(stored, updates, ["id"]).select("id")


@query("first_seen_log", """SELECT user_id, event_type, min(day(ts) // 8) AS batch FROM events GROUP BY 1, 2""")
def first_seen_log(spark, folder):
    """What each user did, logged in the batch in which it was first seen; the second batch is delivered twice."""
    events = p.table(spark, folder, "events").select("user_id", "event_type", F.floor(F.dayofmonth("ts") / 8).alias("batch"))
    log = KeyedLog(spark, scratch_path(spark, "first-seen"), "user_id BIGINT, event_type STRING, batch BIGINT",
                   ("user_id", "event_type"), ("user_id",), buckets=8)
    for number in (0, 1, 1, 2, 3):
        log.append_new(events.filter(F.col("batch") == number))
    return log.read()


@query("latest_order_per_customer", """SELECT o_custkey AS customer, max(o_orderkey) AS order_key FROM orders
  JOIN (SELECT o_custkey AS c, max(o_orderdate) AS d FROM orders GROUP BY 1) ON o_custkey = c AND o_orderdate = d GROUP BY 1""")
def latest_order_per_customer(spark, folder):
    orders = p.table(spark, folder, "orders").selectExpr("o_custkey AS customer", "o_orderkey AS order_key", "o_orderdate")
    return tables.latest_per_key(orders, ["customer"], ["o_orderdate", "order_key"]).select("customer", "order_key")


@query("last_events_per_user", """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5""")
def last_events_per_user(spark, folder):
    return tables.keep_last_per_key(p.table(spark, folder, "events"), ["user_id"], 5, ["ts", "event_id"]).select(
        "user_id", "event_id")


@query("event_log_tail", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def event_log_tail(spark, folder):
    return tables.keep_last(p.table(spark, folder, "events"), 1000, ["ts", "event_id"]).select("event_id", "event_type")


@query("recommendations_swap", """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'historical' ELSE 'draft' END AS status FROM part
  UNION ALL SELECT s_suppkey, 'active' FROM supplier""")
def recommendations_swap(spark, folder):
    stored = p.table(spark, folder, "part").selectExpr("p_partkey AS id", "if(p_size % 2 = 0, 'active', 'draft') AS status")
    return tables.swap_recommendations(stored, p.table(spark, folder, "supplier").selectExpr("s_suppkey AS id"))


_A = "SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS t FROM orders WHERE o_orderkey % 10 <> 1"
_B = "SELECT o_orderkey AS k, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS c, o_totalprice AS t FROM orders WHERE o_orderkey % 10 <> 2"


def _two(spark, folder):
    orders = p.table(spark, folder, "orders")
    a = orders.filter("o_orderkey % 10 <> 1").selectExpr("o_orderkey AS k", "o_custkey AS c", "o_totalprice AS t")
    b = orders.filter("o_orderkey % 10 <> 2").selectExpr(
        "o_orderkey AS k", "o_custkey + if(o_orderkey % 7 = 0, 1, 0) AS c", "o_totalprice AS t")
    return a, b


@query("dataset_diff", f"""SELECT k, CASE WHEN b.t IS NULL THEN 'only_a' WHEN a.t IS NULL THEN 'only_b' WHEN a.c <> b.c THEN 'changed'
  ELSE 'same' END AS status, CASE WHEN a.c <> b.c THEN 'c' ELSE '' END AS changed_columns FROM ({_A}) a FULL JOIN ({_B}) b USING (k)""")
def dataset_diff(spark, folder):
    return rows.compare_rows(*_two(spark, folder), ["k"])


@query("dataset_changes", f"""SELECT k, CASE WHEN b.t IS NULL THEN 'only_a' WHEN a.t IS NULL THEN 'only_b' ELSE 'changed' END AS status,
  CASE WHEN a.c <> b.c THEN 'c' ELSE '' END AS changed_columns FROM ({_A}) a FULL JOIN ({_B}) b USING (k) WHERE b.t IS NULL OR a.t IS NULL OR a.c <> b.c""")
def dataset_changes(spark, folder):
    """The same comparison by digests of buckets: rows that are the same in both do not meet."""
    return rows.compare_changes(*_two(spark, folder), ["k"])


@query("dataset_diff_counts", f"""SELECT CASE WHEN b.t IS NULL THEN 'only_a' WHEN a.t IS NULL THEN 'only_b' WHEN a.c <> b.c THEN 'changed'
  ELSE 'same' END AS status, count(*) AS row_count FROM ({_A}) a FULL JOIN ({_B}) b USING (k) GROUP BY 1""")
def dataset_diff_counts(spark, folder):
    return rows.compare_counts(*_two(spark, folder), ["k"])


@query("rows_only_in_first", f"({_A}) EXCEPT ALL ({_B})")
def rows_only_in_first(spark, folder):
    return rows.row_difference(*_two(spark, folder))


@query("rows_in_both", f"({_A}) INTERSECT ({_B})")
def rows_in_both(spark, folder):
    return rows.row_intersection(*_two(spark, folder))


@query("record_map_diff", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE '' END AS only_a, 'b' AS only_b,
  'k,s' AS shared, CASE WHEN user_id % 2 = 0 THEN 'k' ELSE '' END AS changed FROM events""")
def record_map_diff(spark, folder):
    events = p.table(spark, folder, "events").selectExpr(
        "event_id", "map_filter(map('k', CAST(user_id AS STRING), 's', event_type, 'a', if(event_id % 2 = 0, '1', NULL)), (k, v) -> v IS NOT NULL) AS x",
        "map('k', CAST(if(user_id % 2 = 0, user_id + 1, user_id) AS STRING), 's', event_type, 'b', '2') AS y")
    return events.select("event_id", rows.compare_maps(F.col("x"), F.col("y")).alias("d")).select("event_id", "d.*")


@query("clean_records", """SELECT p_partkey, p_name AS name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'none' END AS size FROM part""")
def clean_records(spark, folder):
    parts = p.table(spark, folder, "part").selectExpr(
        "p_partkey", "map('NAME', concat('  ', p_name, ' '), 'Size', if(p_size % 2 = 0, CAST(p_size AS STRING), NULL)) AS r")
    cleaned = parts.select("p_partkey", rows.clean_map(F.col("r")).alias("r"))
    return cleaned.select("p_partkey", F.element_at("r", "name").alias("name"),
                          F.coalesce(F.try_element_at("r", F.lit("size")), F.lit("none")).alias("size"))


@query("row_steps", "SELECT p_partkey, trim(p_name) AS p_name FROM part WHERE p_size > 25")
def row_steps(spark, folder):
    steps = rows.Steps().add("lower", rows.lowercase_columns).add("strip", rows.strip_strings).add(
        "large", lambda f: f.filter("p_size > 25"))
    source = p.table(spark, folder, "part").selectExpr("p_partkey AS P_PARTKEY", "concat(' ', p_name) AS P_Name", "p_size AS P_SIZE")
    return steps.run(source).select("p_partkey", "p_name")


@query("row_operations", """SELECT p_partkey, p_retailprice FROM part WHERE p_type = 'ECONOMY' ORDER BY p_retailprice, p_partkey LIMIT 50""")
def row_operations(spark, folder):
    """Two sorts, the second of which keeps the order of the first among equal prices."""
    source = p.table(spark, folder, "part").select("p_partkey", "p_type", "p_retailprice")
    out, _ = rows.apply_operations(source, ["filter:p_type:ECONOMY", "sort:p_partkey", "sort:p_retailprice", "shuffle:x", "limit:50"])
    return out.select("p_partkey", "p_retailprice")


@query("read_only_query", "SELECT count(*) AS n FROM (SELECT c_mktsegment, count(*) FROM customer WHERE c_acctbal > 100 GROUP BY 1)")
def read_only_query(spark, folder):
    p.table(spark, folder, "customer").createOrReplaceTempView("customer_read_only")
    out = generic.read_only_sql(
        spark, "SELECT c_mktsegment, count(*) AS n FROM customer_read_only WHERE c_acctbal > :low GROUP BY 1;", {"low": 100})
    return out.agg(F.count_if(F.get_json_object("row", "$.n").cast("bigint") > 0).alias("n"))


# ---------------------------------------------------------------------- graph
def _entities(spark, folder):
    """Answers with entities of every document, as an extractor returns them."""
    answers = p.table(spark, folder, "documents").selectExpr(
        "source", "concat('```json\n', to_json(map('people', array(concat('person ', doc_id % 11)), 'locations', "
        "array(lang, concat('city ', doc_id % 5)))), '\n```') AS answer")
    return graph.parse_entities(answers, "source", "answer")


_MENTIONS = """m AS (SELECT source, 'People' AS type, 'person ' || (doc_id % 11) AS name FROM documents
  UNION SELECT source, 'Locations', lang FROM documents UNION SELECT source, 'Locations', 'city ' || (doc_id % 5) FROM documents)"""


@query("graph_nodes", f"WITH {_MENTIONS} SELECT 'Source' AS type, source AS name FROM m UNION SELECT type, name FROM m")
def graph_nodes(spark, folder):
    return graph.nodes(_entities(spark, folder))


@query("graph_edges", f"WITH {_MENTIONS} SELECT DISTINCT source, 'CONTAINS' AS relation, type AS target_type, name AS target FROM m")
def graph_edges(spark, folder):
    return graph.edges(_entities(spark, folder))


@query("graph_merge", """SELECT 'Customer' AS type, CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
  CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM customer""")
def graph_merge(spark, folder):
    base = p.table(spark, folder, "customer")
    def made(f):
        return graph.record_nodes(rows.to_map(f).selectExpr("record", "'crm' AS source", "'table' AS source_type"), "Customer", "id")

    stored = made(base.selectExpr("c_custkey AS id", "c_name AS name", "'old' AS state"))
    fresh = made(base.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "'new' AS state"))
    merged = graph.merge_nodes(stored, fresh)
    return merged.select("type", "id", F.element_at("properties", "name").alias("name"),
                         F.element_at("properties", "state").alias("state"))


@query("graph_relationships", "SELECT CAST(c_custkey AS VARCHAR) AS from_id, CAST(n_nationkey AS VARCHAR) AS to_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_relationships(spark, folder):
    customers, nations = p.table(spark, folder, "customer"), p.table(spark, folder, "nation")
    ends = customers.selectExpr("'Customer' AS type", "CAST(c_custkey AS STRING) AS id").unionByName(
        nations.selectExpr("'Nation' AS type", "CAST(n_nationkey AS STRING) AS id"))
    pairs = customers.selectExpr("'Customer' AS from_type", "CAST(c_custkey AS STRING) AS from_id",
                                 "'Nation' AS to_type", "CAST(c_nationkey AS STRING) AS to_id")
    return graph.relationships(pairs, ends, "LIVES_IN").select("from_id", "to_id")
