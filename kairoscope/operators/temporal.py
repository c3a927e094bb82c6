"""Temporal edges: upsert, contradictions, statistics, decay, archive, prune, weights.

An edge is known by project_id, subject, predicate, object, valid_from and valid_to (microseconds; a
null end is open). All moments are arguments; nothing reads the clock.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions import interval as I
from kairoscope.operators.retrieval import small
from kairoscope.session import materialise

EDGE = ["project_id", "subject", "predicate", "object", "valid_from", "valid_to"]
FAMILY = ["project_id", "subject", "predicate", "object"]
#: Fixed values of pruning: observations, variance in square microseconds and score from which a family is stable, relevance below which an edge goes.
PRUNE_N, PRUNE_VARIANCE, PRUNE_SCORE, PRUNE_RELEVANCE = 3, 3.6e12, 8.0, 0.1
PENALTY = 0.9
#: Stretches of time in which intervals are counted: 32 days.
BUCKET_US = 32 * 24 * I.HOUR_US
#: Edges of a project, subject and predicate up to which they are compared in one row.
SMALL_GROUP = 100


def upsert_edges(observations: DataFrame, existing: DataFrame | None = None, parts: int | None = None, by: list[str] | None = None) -> DataFrame:
    """EDGE, confidence and relevance (the largest), support (observations), first_seen, last_seen.

    ``observations`` have EDGE, confidence and observed_at. ``existing`` is an earlier result; adding a
    batch to it gives what one run over all gives. ``parts``: the number of tasks, by default the session's. ``by``: columns of EDGE whose
    rows one task has, for what follows by these; none of their values may have more rows than a task takes.
    """
    rows = observations.select(*EDGE, I.clamp(F.col("confidence")).alias("confidence"), I.clamp(F.col("confidence")).alias("relevance"), F.lit(1).cast("long").alias("support"), F.col("observed_at").alias("first_seen"), F.col("observed_at").alias("last_seen"))
    if existing is not None:
        rows = existing.select(*rows.columns).unionByName(rows)
    if parts is not None:
        rows = rows.repartition(parts, *(by or EDGE))
    elif by:
        rows = rows.repartition(*by)
    return rows.groupBy(*EDGE).agg(F.max("confidence").alias("confidence"), F.max("relevance").alias("relevance"), F.sum("support").alias("support"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def rivals(edges: DataFrame, bucket_us: int = BUCKET_US, small_group: int = SMALL_GROUP) -> DataFrame:
    """``edges`` with the edges of their project, subject and predicate whose objects differ and whose intervals meet: rivals (how many) and first_rival (object and start).

    A group of up to ``small_group`` edges is compared within its own row, so that an edge is shuffled once and no pair is.
    The intervals of larger groups are dealt to stretches of time (_rivals_by_time()).
    """
    rows = materialise(edges.select(*EDGE), "edges")  # counted first, then compared
    group = FAMILY[:3]
    large = materialise(rows.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > small_group).select(*group), "large")
    found, few = None, rows
    if large.take(1):
        in_large = lambda how: rows.alias("r").join(small(large).alias("g"), [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in group], how)
        found, few = _rivals_by_time(in_large("left_semi"), bucket_us), in_large("left_anti")
    lists = few.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*EDGE[3:]))).alias("all"))
    meet = lambda a, b: (a["object"] != b["object"]) & I.overlaps(a["valid_from"], a["valid_to"], b["valid_from"], b["valid_to"])
    each = lists.select(*group, F.explode(F.transform("all", lambda a: F.struct(a.alias("own"), F.filter("all", lambda b: meet(a, b)).alias("met")))).alias("e"))
    first = F.get("e.met", F.lit(0))  # lists are in order
    out = each.select(*group, *[F.col(f"e.own.{c}") for c in EDGE[3:]], F.size("e.met").cast("long").alias("rivals"), F.when(first.isNotNull(), F.struct(first["object"].alias("object"), first["valid_from"].alias("valid_from"))).alias("first_rival"))
    return out if found is None else out.unionByName(found)


def _rivals_by_time(rows: DataFrame, bucket_us: int) -> DataFrame:
    """rivals() for groups of any size.

    Intervals are dealt to stretches of time of ``bucket_us``; a pair is looked at where the later of its starts lies,
    so that only edges of one stretch meet. An open interval goes up to the last start of all.
    """
    rows = rows.select(*EDGE, F.xxhash64(*EDGE).alias("edge_id"))
    last = rows.agg(F.max("valid_from").alias("last"))
    place = lambda c: F.floor(c / F.lit(bucket_us)).cast("long")
    ends = F.least(F.coalesce("valid_to", "last"), F.col("last"))
    spread = rows.crossJoin(F.broadcast(last)).withColumn("bucket", F.explode(F.sequence(place(F.col("valid_from")), F.greatest(place(F.col("valid_from")), place(ends)))))  # one row
    starts = rows.withColumn("bucket", place(F.col("valid_from")))
    a, b = spread.alias("a"), starts.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*FAMILY[:3], "bucket")]
    # The edge of the later start comes from ``starts``; of equal starts the larger object does.
    later = (F.col("a.valid_from") < F.col("b.valid_from")) | ((F.col("a.valid_from") == F.col("b.valid_from")) & (F.col("a.object") < F.col("b.object")))
    meet = I.overlaps(F.col("a.valid_from"), F.col("a.valid_to"), F.col("b.valid_from"), F.col("b.valid_to"))
    pairs = a.join(b, [*same, F.col("a.object") != F.col("b.object"), later, meet])
    sides = F.array(*[F.struct(F.col(f"{x}.edge_id").alias("edge_id"), F.col(f"{y}.object").alias("object"), F.col(f"{y}.valid_from").alias("valid_from")) for x, y in ("ab", "ba")])
    each = pairs.select(F.explode(sides).alias("p")).select("p.edge_id", F.struct("p.object", "p.valid_from").alias("rival"))
    found = each.groupBy("edge_id").agg(F.count("*").alias("rivals"), F.min("rival").alias("first_rival"))
    return rows.join(found, "edge_id", "left").select(*EDGE, F.coalesce("rivals", F.lit(0)).alias("rivals"), "first_rival")


def contradiction_counts(edges: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """``edges`` with their number of contradicting edges, without making pairs.

    The intervals that meet one are those that start by its end less those that end before its start;
    both come from running counts over the sorted ends, for all edges of the group and for those of
    the same object. A count runs within a stretch of time; what came before it is added from the
    counts of whole stretches, so that a large group is many tasks. Open ends are in no stretch.
    """
    edges = materialise(edges, "edges")  # read by every count, made once

    def meeting(keys: list[str]) -> DataFrame:
        k = [F.col(c) for c in keys]
        starts = edges.select(*k, F.col("valid_from").alias("t"), F.lit(0).alias("o"), F.lit(1).alias("s"), F.lit(0).alias("e"), F.lit(None).cast("long").alias("id"))
        closed = edges.where("valid_to IS NOT NULL")
        ends = closed.select(*k, "valid_to", F.lit(2), F.lit(0), F.lit(1), F.lit(None).cast("long"))
        ask_end = closed.select(*k, "valid_to", F.lit(1), F.lit(0), F.lit(0), F.col("edge_id"))
        ask_start = edges.select(*k, F.col("valid_from"), F.lit(-1), F.lit(0), F.lit(0), F.col("edge_id"))
        rows = starts.union(ends).union(ask_end).union(ask_start).withColumn("bucket", F.floor(F.col("t") / bucket_us).cast("long"))
        ahead = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        whole = rows.groupBy(*keys, "bucket").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
        whole = whole.select(*keys, "bucket", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in "se"])
        run = Window.partitionBy(*keys, "bucket").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in (*keys, "bucket")]
        counted = rows.select("*", F.sum("s").over(run).alias("begun"), F.sum("e").over(run).alias("over")).where("id IS NOT NULL")
        counted = counted.alias("r").join(whole.alias("w"), same).select("id", "o", (F.col("begun") + F.col("s_before")).alias("begun"), (F.col("over") + F.col("e_before")).alias("over"))
        # By an open end everything has begun.
        totals = edges.groupBy(*keys).agg(F.count("*").alias("begun"))
        alike = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in keys]
        open_ = edges.where("valid_to IS NULL").alias("r").join(totals.alias("w"), alike).select(F.col("edge_id").alias("id"), F.lit(1).alias("o"), "begun", F.lit(0).cast("long").alias("over"))
        counted = counted.union(open_)
        return counted.groupBy("id").agg((F.max(F.when(F.col("o") == 1, F.col("begun"))) - F.max(F.when(F.col("o") == -1, F.col("over")))).alias("n"))

    all_ = meeting(FAMILY[:3]).withColumnRenamed("n", "n_all")
    own = meeting(FAMILY).withColumnRenamed("n", "n_own")
    return edges.join(all_.join(own, "id").select(F.col("id").alias("edge_id"), (F.col("n_all") - F.col("n_own")).alias("contradictions")), "edge_id")


def penalised(edges: DataFrame) -> DataFrame:
    """Contradictions applied once to ``edges`` with contradictions counted: relevance by PENALTY for each."""
    return edges.withColumn("relevance", F.col("relevance") * F.pow(F.lit(PENALTY), F.col("contradictions")))


def family_stats(observations: DataFrame) -> DataFrame:
    """FAMILY, n, mean_us, m2 and the description length score of the observations' midpoints."""
    mid = I.midpoint(F.col("valid_from"), F.col("valid_to")).cast("double")
    out = observations.groupBy(*FAMILY).agg(F.count("*").alias("n"), F.avg(mid).alias("mean_us"), F.coalesce(F.var_samp(mid), F.lit(0.0)).alias("variance"))
    score = F.log(F.col("n") + 1.0) + F.col("n") / 2.0 * F.log(F.col("variance") + 1e-9)
    return out.withColumn("m2", F.col("variance") * (F.col("n") - 1)).withColumn("mdl_score", score)


def decay(edges: DataFrame, now_us: int) -> DataFrame:
    """``edges`` with relevance decayed since last_seen; changes below 1e-6 are left out."""
    hours = (F.lit(now_us) - F.col("last_seen")) / F.lit(float(I.HOUR_US))
    new = I.decayed(F.col("relevance"), hours)
    return edges.withColumn("relevance", F.when(F.abs(new - F.col("relevance")) < 1e-6, F.col("relevance")).otherwise(new))


def split_expired(edges: DataFrame, now_us: int) -> tuple[DataFrame, DataFrame]:
    """Edges to keep, and archive rows of those that ended before ``now_us``."""
    expired = F.col("valid_to").isNotNull() & (F.col("valid_to") < now_us)
    archive = edges.where(expired).withColumn("reason", F.lit("expired_interval")).withColumn("snapshot", F.to_json(F.struct(*edges.columns)))
    return edges.where(~expired), archive


def mdl_prune(edges: DataFrame, observations: DataFrame) -> DataFrame:
    """EDGE, relevance and archived after as many rounds as the group has stable families.

    A group is one project, subject and predicate. In a round all live edges but the dominant one
    (support, confidence and relevance multiplied; ties by object and interval) lose half of their
    relevance; weak or contradicted ones go. Each round finds the dominant edges by one aggregation.
    """
    stats = family_stats(observations).where((F.col("n") >= PRUNE_N) & (F.col("variance") >= PRUNE_VARIANCE) & (F.col("mdl_score") >= PRUNE_SCORE))
    rounds = stats.groupBy(*FAMILY[:3]).agg(F.count("*").alias("rounds"))
    rows = edges.join(rounds, FAMILY[:3], "left").withColumns({"rounds": F.coalesce("rounds", F.lit(0)), "archived": F.lit(False)})
    rows = materialise(rows, "prune")
    settled, rows = [rows.where("rounds = 0")], rows.where("rounds > 0")  # groups whose rounds are over are not written again
    end = F.coalesce("valid_to", F.lit(I.FOREVER))
    for n in range(1, (rows.agg(F.max("rounds")).first()[0] or 0) + 1):
        order = F.struct((-F.col("support") * F.col("confidence") * F.col("relevance")).alias("w"), "object", "valid_from", end.alias("end"))
        tops = rows.where(~F.col("archived")).groupBy(*FAMILY[:3]).agg(F.min(order).alias("top"), F.count("*").alias("live")).where("live > 1").drop("live")
        hit = ~F.col("archived") & F.col("top").isNotNull() & ((F.col("object") != F.col("top.object")) | (F.col("valid_from") != F.col("top.valid_from")) | (end != F.col("top.end")))
        half = F.when(hit, F.col("relevance") * 0.5).otherwise(F.col("relevance"))
        rows = rows.join(tops, FAMILY[:3], "left").withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("relevance", half)
        gone = F.col("archived") | (F.col("hit") & ((F.col("relevance") < PRUNE_RELEVANCE) | (F.col("contradictions") > 0)))
        rows = materialise(rows.withColumn("archived", gone).drop("top", "hit"), "prune")
        settled.append(rows.where(F.col("rounds") == n))
        rows = rows.where(F.col("rounds") > n)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(*EDGE, "relevance", "archived")


def with_weight(edges: DataFrame, at_us: int, half_life_hours: float, least_relevance: float = 0.0) -> DataFrame:
    """``edges`` with their transition weight at a moment. Edges outside their interval stay, weaker."""
    away = I.distance(F.col("valid_from"), F.col("valid_to"), F.lit(at_us))
    return edges.where(F.col("relevance") >= least_relevance).withColumn("weight", I.transition_weight(F.col("confidence"), F.col("relevance"), away, half_life_hours, F.col("contradictions")))


def weighted(edges: DataFrame, at_us: int, half_life_hours: float, least_relevance: float = 0.0) -> DataFrame:
    """``edges`` with_weight() and the total of their subject."""
    rows = with_weight(edges, at_us, half_life_hours, least_relevance)
    totals = rows.groupBy("project_id", "subject").agg(F.sum("weight").alias("total"))
    return rows.join(totals, ["project_id", "subject"])


def active_at(edges: DataFrame, at_us: int) -> DataFrame:
    """The strict form of as-of: only edges whose interval holds the moment."""
    return edges.where((F.col("valid_from") <= at_us) & (F.coalesce("valid_to", F.lit(I.FOREVER)) >= at_us))


def backfill_valid_from(edges: DataFrame, *sources: str, default: int = 0) -> DataFrame:
    """``valid_from`` where it is null, from the first of the columns that has a value."""
    return edges.withColumn("valid_from", F.coalesce("valid_from", *sources, F.lit(default)))


def project_stats(edges: DataFrame) -> DataFrame:
    """Per project: edges, distinct nodes, evidence, and edges of each predicate as a sorted text list."""
    by_predicate = edges.groupBy("project_id", "predicate").agg(F.count("*").alias("n"), F.sum("support").alias("support"))
    lists = by_predicate.groupBy("project_id").agg(F.sum("n").alias("edges"), F.sum("support").alias("evidence"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "predicate", F.col("n").cast("string")))), ",").alias("by_predicate"))
    nodes = edges.select("project_id", F.explode(F.array(F.concat(F.lit("s:"), F.col("subject").cast("string")), F.concat(F.lit("o:"), F.col("object").cast("string")))).alias("node")).distinct().groupBy("project_id").agg(F.count("*").alias("nodes"))
    return lists.join(nodes, "project_id")


def variance_of(values: list[float]) -> float:
    """Running mean and squares of a stream, as the keyed state keeps them."""
    n, mean, m2 = 0, 0.0, 0.0
    for x in values:
        n += 1
        d = x - mean
        mean += d / n
        m2 += d * (x - mean)
    return m2 / (n - 1) if n > 1 else math.nan
