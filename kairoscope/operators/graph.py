"""Graph expansion, personalised PageRank, closures and symbol resolution.

Edges are (src, dst, weight). Iterations write their state to the shared folder, so that lineage
stays short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.operators.retrieval import small
from kairoscope.session import materialise, tasks

ROUNDS, TOLERANCE = 12, 1e-6
#: Steps out of a node from which it may be a hub, and the most hubs that are sent to all tasks.
HUB, BROADCAST_ROWS = 64, 1_000_000
#: Edges of a task in walk_within(): sums for hubs are shuffled once for each task.
STEP_ROWS = 1_000_000


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, hop: everything within so many undirected hops of the seeds (column node)."""

    def beside(nodes: DataFrame) -> DataFrame:
        nodes = small(nodes)
        ways = [nodes.join(edges, F.col("node") == F.col(a)).select(F.col(b).alias("node")) for a, b in (("src", "dst"), ("dst", "src"))]
        return ways[0].union(ways[1])

    return reached(beside, seeds.select("node"), hops)


def reached(beside: Callable[[DataFrame], DataFrame], seeds: DataFrame, hops: int) -> DataFrame:
    """The columns of ``seeds``, by which a node is known, and hop: everything within so many hops of the seeds.

    ``beside``: the neighbours of nodes (with repeats, if it likes), so that edges that no hop meets need not be made.
    """
    seen = found = materialise(seeds.distinct().withColumn("hop", F.lit(0)), "frontier")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in seeds.columns]
    for hop in range(1, hops + 1):
        found = beside(found.drop("hop")).distinct().alias("f").join(seen.alias("s"), same, "left_anti")
        found = materialise(found.withColumn("hop", F.lit(hop)), "frontier")
        seen = seen.union(found)
    return seen


class _Steps:
    """The steps of a walk, dealt to tasks once, so that a round shuffles what nodes have and no edge.

    ``edges``: ``part``, src, dst, weight. Steps lie with their source, and sums for nodes that many steps lead to are made
    before they are shuffled. Steps out of a hub, a node with many steps, lie with their ends instead, where a
    round sends what the hubs have: they are BROADCAST_ROWS at most, as their least degree grows with the edges.
    """

    def __init__(self, edges: DataFrame, part: list[str]):
        self.part = part
        own = Window.partitionBy(*part, "src")
        # The edges of a node come to one task once, which merges them and then shares them out.
        rows = edges.select(*part, "src", "dst", "weight").repartition(*part, "src").groupBy(*part, "src", "dst").agg(F.sum("weight").alias("weight"))
        rows = rows.select(*part, "src", "dst", (F.col("weight") / F.sum("weight").over(own)).alias("p"), F.count("*").over(own).alias("degree"))
        self.rows = materialise(rows, "steps")
        count = self.rows.count()
        hub = F.col("degree") > max(HUB, -(-count // BROADCAST_ROWS))
        # No fewer tasks than the session's: Spark would deal a join's smaller side again.
        many = max(tasks(count), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))

        def kept(rows: DataFrame, end: str) -> DataFrame:
            rows = rows.drop("degree").repartition(many, *part, end).persist(StorageLevel.DISK_ONLY)
            rows.count()  # only rows that are there already tell a join's plan how they lie
            return rows

        self.out, self.into = kept(self.rows.where(~hub), "src"), None
        self.hubs = materialise(self.rows.where(hub).select(*part, F.col("src").alias("node")).distinct(), "hubs")
        if self.hubs.take(1):
            self.into = kept(self.rows.where(hub), "dst")

    def pushed(self, rows: DataFrame) -> DataFrame:
        """``part``, node, d: what ``rows`` (``part``, node, d) send along their steps, not yet summed over tasks."""
        sent = lambda rows, steps: rows.select(*self.part, F.col("node").alias("src"), "d").join(steps, [*self.part, "src"]).groupBy(*self.part, F.col("dst").alias("node")).agg(F.sum(F.col("d") * F.col("p")).alias("d"))
        some = sent(rows, self.out)
        if self.into is None:
            return some
        hubs = rows.join(F.broadcast(self.hubs), [*self.part, "node"], "left_semi")  # BROADCAST_ROWS at most
        return some.union(sent(F.broadcast(hubs), self.into))

    def release(self) -> None:
        for kept in (self.out, self.into):
            if kept is not None:
                kept.unpersist()


def pagerank(edges: DataFrame, seeds: DataFrame, restart: float, dangling_to_seeds: bool, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """node, rank: personalised PageRank with uniform seeds; ``tolerance``: the change of all ranks that ends it.

    Without ``dangling_to_seeds`` the mass of nodes without a way out is lost, as a directed walk loses it.
    """
    dealt = _Steps(edges, [])
    steps = dealt.rows
    seeds = seeds.select("node").distinct()
    share = 1.0 / max(1, seeds.count())
    nodes = steps.select(F.col("src").alias("node")).union(steps.select("dst")).union(seeds).distinct()
    start = materialise(nodes.join(seeds.withColumn("s", F.lit(share)), "node", "left").select("node", F.coalesce("s", F.lit(0.0)).alias("seed")), "nodes")
    ranks = start.select("node", F.col("seed").alias("rank"))
    sources = steps.select(F.col("src").alias("node")).distinct()
    for _ in range(rounds):
        flow = dealt.pushed(ranks.withColumnRenamed("rank", "d")).groupBy("node").agg(F.sum("d").alias("flow"))
        lost = 0.0
        if dangling_to_seeds:
            lost = ranks.join(sources, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        new = start.join(flow, "node", "left").select("node", (restart * F.col("seed") + (1 - restart) * (F.coalesce("flow", F.lit(0.0)) + lost * F.col("seed"))).alias("rank"))
        new = materialise(new, "ranks")
        if tolerance is not None:
            change = new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if change is None or change < tolerance:
                ranks = new
                break
        ranks = new
    dealt.release()
    return ranks


def capped_reach(sides: DataFrame, seeds: DataFrame, hops: int, most: int | None) -> DataFrame:
    """query_id, project_id, node within so many undirected hops of a question's seeds, at most ``most`` nodes a question and project.

    ``sides``: project_id, src, dst, weight. Where a hop finds more new nodes than the budget has room for, those with
    the heaviest edge to the nodes before it are taken, of equal ones the first by name. Seeds always count. Of a
    node's edges only the ``most`` heaviest can matter (those known and those taken are ``most`` together), so no
    question costs the degree of a hub. Without ``most``, everything within the hops.
    """
    keys = ["query_id", "project_id", "node"]
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("next")), F.struct(F.col("dst").alias("node"), F.col("src").alias("next")))
    both = sides.where("src <> dst").select("project_id", "weight", F.explode(ends).alias("e")).select("project_id", "e.node", "e.next", F.round("weight", 12).alias("weight"))
    # A node's edges come to one task once, which merges and then ranks them.
    both = both.repartition("project_id", "node").groupBy("project_id", "node", "next").agg(F.max("weight").alias("weight"))
    if most is not None:
        order = Window.partitionBy("project_id", "node").orderBy(F.desc("weight"), "next")
        both = both.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
    both = materialise(both, "adjacent")
    seen = frontier = materialise(seeds.select(*keys).distinct(), "reach")
    for _ in range(hops):
        if most is not None:
            # A question whose budget is full asks for no more edges.
            have = seen.groupBy("query_id", "project_id").agg(F.count("*").alias("have"))
            have = materialise(have.where(F.col("have") < most), "room")
            frontier = frontier.join(have.select("query_id", "project_id"), ["query_id", "project_id"], "left_semi")
        found = frontier.join(both, ["project_id", "node"]).groupBy("query_id", "project_id", F.col("next").alias("node")).agg(F.max("weight").alias("weight")).join(seen, keys, "left_anti")
        if most is not None:
            place = F.row_number().over(Window.partitionBy("query_id", "project_id").orderBy(F.desc("weight"), "node"))
            found = found.withColumn("place", place).where(F.col("place") <= most).join(have, ["query_id", "project_id"]).where(F.col("place") + F.col("have") <= most)
        frontier = materialise(found.select(*keys), "reach")
        seen = seen.union(frontier)
    return seen


def inside(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """``edges`` (project_id, subject, object, ...) once for each question that reaches both of their ends.

    An edge is looked up by the end that fewer edges have, so that a hub that many questions reach is not.
    """
    nodes = materialise(reach.select("project_id", "node").distinct(), "nodes")
    ends = lambda c: nodes.select("project_id", F.col("node").alias(c))
    some = materialise(edges.join(ends("subject"), ["project_id", "subject"], "left_semi").join(ends("object"), ["project_id", "object"], "left_semi"), "inside")
    degree = some.select("project_id", F.col("subject").alias("node")).union(some.select("project_id", "object")).groupBy("project_id", "node").agg(F.count("*").alias("degree"))
    of = lambda c: degree.select("project_id", F.col("node").alias(c), F.col("degree").alias(f"__{c}"))
    some = some.join(of("subject"), ["project_id", "subject"]).join(of("object"), ["project_id", "object"])
    low = F.col("__subject") <= F.col("__object")
    some = some.withColumns({"__by": F.when(low, F.col("subject")).otherwise(F.col("object")), "__other": F.when(low, F.col("object")).otherwise(F.col("subject"))})
    first = some.join(reach.select("query_id", "project_id", F.col("node").alias("__by")), ["project_id", "__by"])
    return first.join(reach.select("query_id", "project_id", F.col("node").alias("__other")), ["query_id", "project_id", "__other"]).select("query_id", *edges.columns)


def walk_each(edges: DataFrame, seeds: DataFrame, part: list[str], restart: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``part``, node, rank: a personalised PageRank of its own for each value of ``part``, with uniform seeds (``part``, node).

    ``edges``: ``part``, src, dst, weight. What a round changes is pushed along the edges of the nodes that changed; a
    part whose changes sum to less than ``tolerance`` is settled and leaves the rounds. The mass of nodes
    without a way out is lost; nodes that no mass reaches are left out.
    """
    damping = 1 - restart
    edges = edges.groupBy(*part, "src", "dst").agg(F.sum("weight").alias("weight"))
    out = edges.groupBy(*part, "src").agg(F.sum("weight").alias("total"))
    steps = materialise(edges.join(out, [*part, "src"]).select(*part, "src", "dst", (F.col("weight") / F.col("total") * damping).alias("p")), "steps")
    seeds = seeds.select(*part, "node").distinct()
    start = materialise(seeds.join(seeds.groupBy(*part).agg(F.count("*").alias("__own")), part).select(*part, "node", (1.0 / F.col("__own")).alias("d")), "start")

    def pushed(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("node", "src").join(steps, [*part, "src"]).select(*part, F.col("dst").alias("node"), (F.col("d") * F.col("p")).alias("d"))

    change = pushed(start).union(start.withColumn("d", -damping * F.col("d")))
    parts = start
    for n in range(rounds):
        change = materialise(change.groupBy(*part, "node").agg(F.sum("d").alias("d")), "change")
        parts = parts.union(change)
        open_ = materialise(change.groupBy(*part).agg(F.sum(F.abs("d")).alias("__moved")).where(F.col("__moved") >= tolerance).select(*part), "open")
        if n + 1 == rounds or not open_.take(1):
            break
        change = pushed(change.join(open_, part, "left_semi"))
    return parts.groupBy(*part, "node").agg(F.sum("d").alias("rank"))


def walk_within(edges: DataFrame, hits: DataFrame, hops: int, restart: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame | None:
    """query_id, node, rank: every node within ``hops`` (one at least) of a question's hits, by a walk of its own over the undirected edges among these.

    ``hits``: query_id, node; those that are no end of an edge have no rows. Each edge has a busy end and a low end; busy ends, the
    hubs, have to be few for each question (BROADCAST_ROWS in all; otherwise None), as they are sent to all tasks. A node that
    is no hub has hubs alone around it, so a walk is known by its hubs: what they send comes back over a low node
    within the task that has this node's edges. These are dealt once, and a round shuffles sums for hubs alone. Changes
    and the end of a part's rounds are those of walk_each().
    """
    count, damping = edges.count(), 1 - restart
    few = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    degree = materialise(edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")), "degree")
    busy = materialise(degree.where(F.col("degree") > max(HUB, -(-2 * count // BROADCAST_ROWS))), "busy")  # fewer than BROADCAST_ROWS
    of = lambda c: F.broadcast(busy.select(F.col("node").alias(c), F.col("degree").alias(f"__{c}")))
    at = lambda c: F.struct(F.coalesce(f"__{c}", F.lit(0)), c)
    low = at("src") < at("dst")
    sides = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("low"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("hub"), "weight")
    hubs = materialise(sides.select("hub").distinct(), "hubs")
    if hubs.count() > BROADCAST_ROWS:
        return None
    is_hub = F.broadcast(hubs.select(F.col("hub").alias("node"), F.lit(True).alias("is_hub")))

    # Reach: all nodes up to the last hop but one, and the hubs of the last. Low nodes of the last are found where their edges are.
    def beside(rows: DataFrame) -> DataFrame:
        rows = few(rows)
        ways = [rows.join(edges, F.col("node") == F.col(a)).select("query_id", F.col(b).alias("node")) for a, b in (("src", "dst"), ("dst", "src"))]
        return ways[0].union(ways[1])

    hits = few(hits.select("query_id", "node").distinct()).join(degree, "node")
    share = 1.0 / F.count("*").over(Window.partitionBy("query_id"))
    seen = frontier = materialise(hits.withColumn("share", share).join(is_hub, "node", "left").select("query_id", "node", "share", "is_hub"), "reach")
    for _ in range(hops - 1):
        found = beside(frontier).distinct().join(seen, ["query_id", "node"], "left_anti")
        frontier = materialise(found.join(is_hub, "node", "left").select("query_id", "node", F.lit(0.0).alias("share"), "is_hub"), "reach")
        seen = seen.union(frontier)
    last = beside(frontier).join(is_hub, "node", "left_semi").distinct().join(seen, ["query_id", "node"], "left_anti")
    near = seen.where("is_hub").select("query_id", "node", "share", F.lit(True).alias("close"))
    near = near.union(last.select("query_id", "node", F.lit(0.0), F.lit(False)))
    near = materialise(near.withColumn("id", F.monotonically_increasing_id()), "near")  # one number for a question's hub
    if near.count() > BROADCAST_ROWS:
        return None

    # Edges of low nodes lie with these, for each question that reaches both ends, sorted as the rounds need them.
    pairs = sides.join(is_hub.withColumnRenamed("node", "low"), "low", "left").select("low", "hub", "weight", F.col("is_hub").isNotNull().alias("both"))
    many = max(edges.sparkSession.sparkContext.defaultParallelism, -(-count // STEP_ROWS))
    own = Window.partitionBy("query_id", "low")
    dealt = pairs.where("NOT both").drop("both").repartition(many, "low")
    dealt = dealt.join(F.broadcast(near.select("query_id", F.col("node").alias("hub"), "id", "close")), "hub")
    dealt = dealt.join(few(seen.where("is_hub IS NULL").select("query_id", F.col("node").alias("low"), "share")), ["query_id", "low"], "left")
    inside = F.max(F.col("close") | F.col("share").isNotNull()).over(own)
    dealt = dealt.select("query_id", "low", "id", "weight", F.coalesce("share", F.lit(0.0)).alias("share"), (F.col("weight") / F.sum("weight").over(own)).alias("p"), F.count("*").over(own).alias("n"), inside.alias("inside"))
    dealt = dealt.where("inside").drop("inside").persist(StorageLevel.DISK_ONLY)
    dealt.count()  # only rows that are there already tell a plan how they lie
    end = lambda c: F.broadcast(near.select("query_id", F.col("node").alias(c), F.col("id").alias(f"{c}_id")))
    among = pairs.where("both").select(F.col("low").alias("src"), F.col("hub").alias("dst"), "weight")
    among = among.union(among.select("dst", "src", "weight")).join(end("src"), "src").join(end("dst"), ["query_id", "dst"])
    among = materialise(among.select(F.col("src_id").alias("id"), "dst_id", "weight"), "among")

    # Rounds: of each hub its last two changes and ranks.
    total = dealt.select("id", "weight").union(among.select("id", "weight")).groupBy("id").agg(F.sum("weight").alias("total"))
    zero = F.lit(0.0)
    state = near.join(total, "id", "left").select("query_id", "node", "id", "share", "total", zero.alias("older"), F.col("share").alias("change"), zero.alias("before"), F.col("share").alias("rank"), zero.alias("moved"))
    state, ends = materialise(state, "state"), None
    for n in range(rounds):
        send = F.broadcast(state.select("id", *[(damping * F.col(c) / F.col("total")).alias(c) for c in ("older", "change")]))  # BROADCAST_ROWS at most
        older, change = (F.sum(F.col(c) * F.col("weight")).over(own) for c in ("older", "change"))
        # What low nodes have from the round before, and from this one.
        was = F.col("share") if n == 0 else older - damping * F.col("share") if n == 1 else older
        now = change - damping * F.col("share") if n == 0 else change
        rows = dealt.join(send, "id").select("id", (damping * was * F.col("p")).alias("d"), (F.abs(now) / F.col("n")).alias("moved"))
        direct = among.join(send, "id").select("dst_id", F.col("change") * F.col("weight"), zero)
        flow = rows.union(direct).groupBy("id").agg(F.sum("d").alias("d"), F.sum("moved").alias("moved"))
        d = F.coalesce("d", zero) - (damping * F.col("share") if n == 0 else zero)
        new = state.drop("moved").join(flow, "id", "left").select("query_id", "node", "id", "share", "total", F.col("change").alias("older"), d.alias("change"), F.col("rank").alias("before"), (F.col("rank") + d).alias("rank"), F.coalesce("moved", zero).alias("moved"))
        state = materialise(new, "state")
        open_ = materialise(state.groupBy("query_id").agg(F.sum(F.abs("change") + F.col("moved")).alias("__moved")).where(F.col("__moved") >= tolerance).select("query_id"), "open")
        go_on = n + 1 < rounds and open_.take(1)
        over = state.join(open_, "query_id", "left_anti") if go_on else state
        ends = over if ends is None else ends.union(over)
        if not go_on:
            break
        state = state.join(open_, "query_id", "left_semi")
    ends = materialise(ends.select("query_id", "node", "rank", "id", (damping * F.col("before") / F.col("total")).alias("d")), "ends")
    lows = dealt.join(F.broadcast(ends.select("id", "d")), "id").groupBy("query_id", "low").agg((restart * F.max("share") + F.sum(F.col("d") * F.col("weight"))).alias("rank"))
    ranks = materialise(ends.select("query_id", "node", "rank").union(lows), "ranks")
    dealt.unpersist()
    return ranks


def blend(baseline: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """node, baseline, rank, combined: 0.6 of the baseline and 0.4 of the rank, each over its maximum."""
    both = ranks.join(baseline.select("node", F.col("score").alias("baseline")), "node", "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))
    top = both.agg(F.max("baseline").alias("mb"), F.max("rank").alias("mr"))
    over = lambda x, m: F.when(F.col(m) > 0, F.col(x) / F.col(m)).otherwise(0.0)
    out = both.crossJoin(F.broadcast(top)).withColumn("combined", F.round(0.6 * over("baseline", "mb") + 0.4 * over("rank", "mr"), 9))  # one row
    return out.select("node", "baseline", "rank", "combined").orderBy(F.desc("combined"), F.desc("baseline"), "node").limit(k)


def closure(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, depth: what depends on the roots over reversed edges, once for each depth at which it is reached."""
    reached, frontier = None, roots.select("node").distinct()
    for d in range(1, depth + 1):
        frontier = edges.join(frontier, edges["dst"] == frontier["node"]).select(F.col("src").alias("node")).distinct()
        frontier = materialise(frontier, "closure")
        level = frontier.withColumn("depth", F.lit(d))
        reached = level if reached is None else reached.union(level)
    return reached


def dependencies(edges: DataFrame) -> DataFrame:
    """node, imports, importers as sorted lists without repeats."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    out = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    in_ = edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("importers"))
    empty = F.array().cast("array<string>")
    return nodes.join(out, "node", "left").join(in_, "node", "left").select("node", F.coalesce("imports", empty).alias("imports"), F.coalesce("importers", empty).alias("importers"))


def resolve_symbols(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """request, kind, signature, candidates: by signature, else qualified name, else short name; several candidates are ambiguous."""
    kinds = [("signature", "signature"), ("qualified", "qualified_name"), ("short", "short_name")]
    found = None
    for order, (kind, column) in enumerate(kinds):
        hit = requests.join(symbols, requests["request"] == symbols[column]).select("request", F.lit(order).alias("o"), F.lit(kind).alias("kind"), "signature")
        found = hit if found is None else found.union(hit)
    per_kind = found.groupBy("request", "o", "kind").agg(F.count("*").alias("candidates"), F.min("signature").alias("signature"))
    best = per_kind.withColumn("r", F.row_number().over(Window.partitionBy("request").orderBy("o"))).where("r = 1")
    out = requests.join(best, "request", "left")
    status = F.when(F.col("kind").isNull(), "missing").when(F.col("candidates") > 1, "ambiguous").otherwise("resolved")
    return out.select("request", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(status == "resolved", F.col("signature")).alias("signature"), status.alias("status"))


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """caller, target, resolved, reason: by qualified name, else position, else a short name that only one function has.

    ``calls``: caller, target, position, short_name; ``functions``: signature, qualified_name, position, short_name.
    """
    by_name = functions.select(F.col("qualified_name").alias("target"), F.col("signature").alias("by_name"))
    by_name = by_name.groupBy("target").agg(F.min("by_name").alias("by_name"))
    by_position = functions.groupBy("position").agg(F.min("signature").alias("by_position"))
    short = functions.groupBy("short_name").agg(F.count("*").alias("n"), F.min("signature").alias("by_short"))
    rows = calls.join(by_name, "target", "left").join(by_position, "position", "left").join(short, "short_name", "left")
    resolved = F.coalesce("by_name", "by_position", F.when(F.col("n") == 1, F.col("by_short")))
    reason = F.when(resolved.isNotNull(), F.when(resolved == F.col("caller"), "self_call")).when(F.col("n") > 1, "ambiguous").otherwise("unknown_target")
    return rows.select("caller", "target", F.when(reason.isNull(), resolved).alias("resolved"), reason.alias("reason"))


def call_diagnostics(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: functions, functions with calls, edges, edges of confidence 0.9 and more, and the shares of both."""
    calls = edges.agg(F.count("*").alias("edges"), F.sum(F.when(F.col("confidence") >= 0.9, 1).otherwise(0)).alias("confident"), F.countDistinct("caller").alias("with_calls"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 9).alias("mean_confidence"))
    total = functions.agg(F.count("*").alias("functions"))
    return calls.crossJoin(total).withColumn("covered", F.round(F.col("with_calls") / F.col("functions"), 9)).withColumn("confident_share", F.round(F.col("confident") / F.col("edges"), 9))  # one row each
