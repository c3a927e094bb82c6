"""How the driver's tables stand in for the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairoscope.functions.interval import micros
from kairoscope.operators.retrieval import small
from kairoscope.session import materialise, tasks

#: The moment that maintenance queries take as now: 2000-01-01 in microseconds.
NOW_US = 946_684_800_000_000
#: Customers of a project that are asked first for claims; where none has any, all are.
ASKED_FIRST = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns of one source; ``ingested_at`` is the first delivery's number, 1."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.lit("chat_cli").alias("source_key"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_index"), "role", F.col("text").alias("content"), F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project_id"), F.lit(1).cast("long").alias("ingested_at"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, and a second delivery with changed content of those with an even index."""
    first = turns(spark, sf_dir)
    return first.union(first.where("turn_index % 2 = 0").withColumn("content", F.concat(F.lit("again "), "content")).withColumn("ingested_at", F.lit(2).cast("long")))


def fine_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim of each line item: customer, status, part, from order to shipping."""
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    orders = o.join(c, F.col("o_custkey") == F.col("c_custkey"))  # before the many items are, so that these are shuffled once
    rows = l.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("c_nationkey").alias("project_id"),
        F.col("o_custkey").alias("subject"),
        F.col("o_orderstatus").alias("predicate"),
        F.col("l_partkey").alias("object"),
        micros(F.col("o_orderdate")).alias("valid_from"),
        F.when(F.col("l_shipdate") > F.col("o_orderdate"), micros(F.col("l_shipdate"))).alias("valid_to"),
        F.greatest(1 - F.col("l_discount"), F.lit(0.0)).alias("confidence"),
        micros(F.col("o_orderdate")).alias("observed_at"),
    )


def first_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, id: the first subject of each project in fine_observations(), without making these."""
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    subjects = c.select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("id"))

    def first(rows: DataFrame) -> DataFrame:
        orders = _kept(o.join(_kept(rows), F.col("o_custkey") == F.col("id")).select("project_id", "id", "o_orderkey"))
        return materialise(l.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("project_id").agg(F.min("id").alias("id")), "first")

    place = F.row_number().over(Window.partitionBy("project_id").orderBy("id"))
    some = first(subjects.withColumn("place", place).where(F.col("place") <= ASKED_FIRST).drop("place"))
    others = subjects.alias("a").join(small(some).alias("b"), F.col("a.project_id").eqNullSafe(F.col("b.project_id")), "left_anti")
    return some.union(first(others))


def fine_beside(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    """project_id, id, kind: what fine_observations() link with ``nodes`` of the same columns, subjects (s) with objects (o).

    Each table is cut down to what is asked for before it meets the next, and no step has more rows than the claims.
    """
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    asked = lambda kind, name: nodes.where((F.col("kind") == kind) & F.col("project_id").isNotNull()).select("project_id", F.col("id").alias(name))
    orders = _kept(o.join(small(asked("s", "o_custkey")), "o_custkey").select("project_id", "o_orderkey"))
    objects = l.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("project_id", F.col("l_partkey").alias("id"), F.lit("o").alias("kind"))
    # A part's items once, however many projects ask for it; the customer then says which project an item is of.
    parts = asked("o", "part")
    items = _kept(l.join(small(parts.select("part").distinct()), F.col("l_partkey") == F.col("part")).select("part", "l_orderkey"))
    bought = _kept(o.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("part", "o_custkey"))
    subjects = c.join(bought, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("project_id"), "part", "o_custkey")
    subjects = subjects.join(small(parts), ["project_id", "part"]).select("project_id", F.col("o_custkey").alias("id"), F.lit("s").alias("kind"))
    return objects.union(subjects)


def _kept(rows: DataFrame) -> DataFrame:
    """``rows`` made once, to be counted and then joined."""
    return small(materialise(rows, "asked"))


def coarse_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim of each order with line items: segment, status, priority, from order to the last shipping."""
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    many, some = tasks(l.count()), tasks(o.count())  # of the files' own counts
    items = l.repartition(many, "l_orderkey").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"), F.min("l_discount").alias("discount"))
    orders = o.repartition(some, "o_custkey").join(c.repartition(some, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.repartition(many, "o_orderkey").join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("c_nationkey").alias("project_id"),
        F.col("c_mktsegment").alias("subject"),
        F.col("o_orderstatus").alias("predicate"),
        F.col("o_orderpriority").alias("object"),
        micros(F.col("o_orderdate")).alias("valid_from"),
        F.when(F.col("last") > F.col("o_orderdate"), micros(F.col("last"))).alias("valid_to"),
        F.greatest(1 - F.col("discount"), F.lit(0.0)).alias("confidence"),
        micros(F.col("o_orderdate")).alias("observed_at"),
    )


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type, weight: suppliers import the parts that they ship, nations have suppliers, regions define nations."""
    l, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    parts = l.select("l_suppkey", "l_partkey").distinct().select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"), F.lit("IMPORTS").alias("type"), F.lit(1.0).alias("weight"))
    suppliers = s.select(name("n", "s_nationkey"), name("s", "s_suppkey"), F.lit("HAS_METHOD"), F.lit(0.9))
    nations = n.select(name("r", "n_regionkey"), name("n", "n_nationkey"), F.lit("DEFINES"), F.lit(0.7))
    return parts.union(suppliers).union(nations)


TURNS_SQL = "t AS (SELECT 'chat_cli' AS source_key, conv_id::VARCHAR AS session_id, turn::INT AS turn_index, role, text AS content, 'p' || (conv_id % 5) AS project_id, 1::BIGINT AS ingested_at FROM conversations)"
DELIVERIES_SQL = TURNS_SQL + ", d AS (SELECT * FROM t UNION ALL SELECT source_key, session_id, turn_index, role, 'again ' || content, project_id, 2 FROM t WHERE turn_index % 2 = 0)"
FINE_SQL = """o AS (
  SELECT c_nationkey AS project_id, o_custkey AS subject, o_orderstatus AS predicate, l_partkey AS object, epoch_us(o_orderdate) AS valid_from,
         CASE WHEN l_shipdate > o_orderdate THEN epoch_us(l_shipdate) END AS valid_to, greatest(1 - l_discount, 0) AS confidence, epoch_us(o_orderdate) AS observed_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
COARSE_SQL = """o AS (
  SELECT c_nationkey AS project_id, c_mktsegment AS subject, o_orderstatus AS predicate, o_orderpriority AS object, epoch_us(o_orderdate) AS valid_from,
         CASE WHEN last > o_orderdate THEN epoch_us(last) END AS valid_to, greatest(1 - discount, 0) AS confidence, epoch_us(o_orderdate) AS observed_at
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last, min(l_discount) AS discount FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
EDGES_SQL = """e AS (SELECT project_id, subject, predicate, object, valid_from, valid_to, max(confidence) AS confidence, max(confidence) AS relevance, count(*) AS support, min(observed_at) AS first_seen, max(observed_at) AS last_seen FROM o GROUP BY project_id, subject, predicate, object, valid_from, valid_to)"""
STRUCTURE_SQL = """g AS (
  SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'IMPORTS' AS type, 1.0::DOUBLE AS weight FROM lineitem
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'HAS_METHOD', 0.9 FROM supplier
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'DEFINES', 0.7 FROM nation)"""
