"""Composite searches for many questions at once: seeds, temporal retrieval, hydration, provenance, policies and tiers.

A question is a row with ``query_id``; every step is keyed by it, so all questions share each scan,
shuffle and round of a walk. Where one question would raise a typed error, its row in the status
table has the reason instead (``required`` raises it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions import interval
from kairoscope.functions import text as T
from kairoscope.operators import graph, temporal
from kairoscope.session import materialise

#: Module names, code policies, widening factors of candidates, and the least number for research.
MODULES = ("code", "web", "conversation")
POLICIES = ("safe", "graph_reranked", "auto")
GRAPH_WIDENING, DENSE_WIDENING, LEXICAL_WIDENING, LEAST_RESEARCH = 3, 8, 4, 30
#: Fixed values of a temporal retrieval: edges, hops, restart, half-life in hours, least relevance, seeds.
MAX_EDGES, MAX_HOPS, ALPHA, HALF_LIFE_HOURS, LEAST_RELEVANCE, MAX_SEEDS = 10, 2, 0.85, 24.0, 0.05, 5


class TemporalRetrievalRequiredError(RuntimeError):
    """A search that needs the temporal graph could not use it; ``reason`` is stable, ``details`` say for what."""

    def __init__(self, module: str, reason: str, details: dict[str, object] | None = None):
        super().__init__(f"temporal retrieval is required for {module}: {reason}")
        self.module, self.reason, self.details = module, reason, details or {}


def normalise_policy(policy: str | None, allow_auto: bool) -> str | None:
    """One of POLICIES, ``safe`` for none given, null for what is not one."""
    name = (policy or "safe").strip().lower()
    return name if name in POLICIES and (allow_auto or name != "auto") else None


def normalise_modules(modules: list[str] | None) -> list[str]:
    """The known modules that are named, each once in order; all of them for none."""
    named = [m.strip().lower() for m in modules or []]
    return [m for m in dict.fromkeys(named) if m in MODULES] or list(MODULES)


def candidate_limit(limit: int, domain: str, graph_reranked: bool = False, widened: int | None = None) -> int:
    """How many candidates a search of ``limit`` rows takes; ``widened``: what a reranker asks for."""
    least = {"code": GRAPH_WIDENING * limit if graph_reranked else limit, "web": LEAST_RESEARCH}.get(domain, limit)
    return max(limit, least, widened or 0)


def best_per_source(rows: DataFrame, keys: list[str], source: str, score: str = "score") -> DataFrame:
    """The row with the largest score of each source; the first one in the order of ``rank`` wins a tie."""
    best = Window.partitionBy(*keys, source).orderBy(F.desc(score), "rank")
    return rows.withColumn("__place", F.row_number().over(best)).where("__place = 1").drop("__place")


def resolve_seeds(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, project_id, node: nodes (project_id, kind, name, node) with the name and kind of a request, or with the name alone if none has both.

    ``requests``: query_id, project_id, name, kind (null: any).
    """
    asked = requests.select("query_id", "project_id", T.name_norm(F.col("name")).alias("name_norm"), F.col("kind").alias("asked")).distinct()
    known = nodes.select("project_id", T.name_norm(F.col("name")).alias("name_norm"), "kind", "node")
    found = asked.join(known, ["project_id", "name_norm"]).withColumn("exact", F.coalesce(F.col("kind") == F.col("asked"), F.col("asked").isNull()))
    best = found.groupBy("query_id", "project_id", "name_norm", "asked").agg(F.max("exact").alias("any_exact"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("query_id", "project_id", "name_norm", "asked")]
    kept = found.alias("f").join(best.alias("b"), same).where(F.col("f.exact") == F.col("b.any_exact"))
    return kept.select("f.query_id", "f.project_id", "f.node").distinct()


def evidence_lists(links: DataFrame, edge: list[str], evidence: str = "evidence_id") -> DataFrame:
    """edge, evidence_ids: what supports each edge, in order."""
    return links.groupBy(*edge).agg(F.array_sort(F.collect_set(evidence)).alias("evidence_ids"))


def hydrate(rows: DataFrame, key: list[str], ids: str, evidence: DataFrame, evidence_id: str, fields: list[str]) -> DataFrame:
    """``rows`` with ``evidence``: for each id of the array ``ids`` that is known, its ``fields``, in the order of the ids."""
    each = rows.select(*key, F.posexplode(ids).alias("pos", evidence_id))
    found = each.join(evidence.select(evidence_id, F.struct(evidence_id, *fields).alias("one")), evidence_id)
    lists = found.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "one"))), lambda x: x["one"]).alias("evidence"))
    return rows.join(lists, key, "left")


def hydrate_turns(ranked: DataFrame, turns: DataFrame, limit: int, role: str | None = None, as_of: str | None = None) -> DataFrame:
    """query_id, session_id, turn_index, role, content, score: the turns that ranked evidence names, each once by its first place, ``limit`` a question.

    ``ranked``: query_id, rank, confidence, relevance, evidence (array of structs with source_kind and source_id).
    Evidence of other kinds, ids whose end is no number, unknown turns, other roles and later turns are left out.
    """
    score = F.coalesce("confidence", F.lit(0.0)) * F.when(F.coalesce("relevance", F.lit(0.0)) == 0, 1.0).otherwise(F.col("relevance"))
    each = ranked.select("query_id", "rank", score.alias("score"), F.posexplode("evidence").alias("pos", "e")).where("e.source_kind = 'conversation_turn'")
    split = each.withColumns({"session_id": F.regexp_extract("e.source_id", "^(.*):([0-9]+)$", 1), "turn_index": F.expr("try_cast(regexp_extract(e.source_id, '^(.*):([0-9]+)$', 2) AS int)")}).where("turn_index IS NOT NULL")
    found = split.join(turns.select("session_id", "turn_index", "role", "content", "ingested_at"), ["session_id", "turn_index"])
    if role is not None:
        found = found.where(F.col("role") == role)
    if as_of is not None:
        found = found.where(F.coalesce(F.col("ingested_at").cast("string"), F.lit("")) <= as_of)
    first = Window.partitionBy("query_id", "session_id", "turn_index").orderBy("rank", "pos")
    found = found.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "pos", "session_id", "turn_index"))
    return found.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "place", "session_id", "turn_index", "role", "content", "score")


def node_budget(max_edges: int) -> int:
    """Nodes that a retrieval of so many edges expands to by default."""
    return max(6 * max_edges, 32)


def temporal_retrieve(edges: DataFrame, seeds: DataFrame, at_us: int, max_edges: int = MAX_EDGES, max_hops: int = MAX_HOPS, alpha: float = ALPHA, half_life_hours: float = HALF_LIFE_HOURS, least_relevance: float = LEAST_RELEVANCE, rounds: int = graph.ROUNDS, max_nodes: int | None = -1, tolerance: float = graph.TOLERANCE) -> DataFrame:
    """The best edges of each question around its seeds (query_id, project_id, node) by a walk in its project.

    ``edges`` have temporal.EDGE, confidence, relevance, contradictions, subject and object as nodes.
    Only edges of enough relevance with both ends within ``max_hops`` of a seed take part, and of a question's
    nodes the first ``max_nodes`` by graph.capped_reach() (None: all; by default node_budget()). An edge scores the
    larger rank of its ends times its share of its subject's weight. Without seeds no rows.
    """
    budget = node_budget(max_edges) if max_nodes == -1 else max_nodes
    away = interval.distance(F.col("valid_from"), F.col("valid_to"), F.lit(at_us))
    weight = interval.transition_weight(F.col("confidence"), F.col("relevance"), away, half_life_hours, F.col("contradictions"))
    live = materialise(edges.where(F.col("relevance") >= least_relevance).withColumn("weight", weight), "live")
    sides = live.groupBy("project_id", F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.max("weight").alias("weight"))
    near = graph.inside(live, graph.capped_reach(sides, seeds, max_hops, budget))
    part = ["query_id", "project_id"]
    near = materialise(near.withColumn("total", F.sum("weight").over(Window.partitionBy(*part, "subject"))), "near")
    ranks = graph.walk_each(near.select(*part, F.col("subject").alias("src"), F.col("object").alias("dst"), "weight"), seeds, part, 1 - alpha, rounds, tolerance)
    r = lambda n: ranks.select(*part, F.col("node").alias(n), F.col("rank").alias(f"rank_{n}"))
    scored = near.join(r("subject"), [*part, "subject"], "left").join(r("object"), [*part, "object"], "left")
    best = F.greatest(F.coalesce("rank_subject", F.lit(0.0)), F.coalesce("rank_object", F.lit(0.0)))
    scored = scored.withColumn("score", F.round(best * F.col("weight") / F.col("total"), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "subject", "object", "predicate", "valid_from", F.asc_nulls_last("valid_to"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_edges).select("query_id", "rank", *temporal.EDGE, "confidence", "relevance", "score")


def seeds_of_hits(hits: DataFrame, most: int = MAX_SEEDS) -> DataFrame:
    """query_id, name, kind: the entities of ranked hits (query_id, rank, score, entities) by score over position, summed."""
    score = F.when(F.coalesce("score", F.lit(0.0)) == 0, 1.0).otherwise(F.col("score"))
    each = hits.select("query_id", "rank", score.alias("s"), F.posexplode("entities").alias("pos", "e"))
    sums = each.groupBy("query_id", F.lower("e.name").alias("key"), F.col("e.kind").alias("kind")).agg(F.round(F.sum(F.col("s") / (F.col("pos") + 1)), 9).alias("weight"), F.min_by("e.name", F.struct("rank", "pos")).alias("name"), F.min("rank").alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "first", "key", "kind"))
    return sums.withColumn("place", place).where(F.col("place") <= most).select("query_id", "name", "kind", "weight", "place")


def projects_of_hits(hits: DataFrame) -> DataFrame:
    """query_id, project_id: the project with the largest sum of scores among a question's hits; the one seen first wins a tie."""
    score = F.when(F.coalesce("score", F.lit(0.0)) == 0, 1.0).otherwise(F.col("score"))
    sums = hits.where("project_id IS NOT NULL").groupBy("query_id", "project_id").agg(F.round(F.sum(score), 9).alias("total"), F.min("rank").alias("first"))
    return sums.groupBy("query_id").agg(F.max_by("project_id", F.struct("total", -F.col("first"))).alias("project_id"))


def provenance(module: str, mode: str | Column, temporal_applied: bool, sources: list[str]) -> Column:
    """Where a hit comes from, as a struct."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.struct(F.lit(module).alias("module"), mode.alias("mode"), F.lit(temporal_applied).alias("temporal_applied"), F.array(*[F.lit(s) for s in sources]).alias("candidate_sources"))


def as_research_rows(retrieved: DataFrame) -> DataFrame:
    """Temporal results as research rows: the first evidence, else the names of both ends, is the source; confidence times relevance the score."""
    first = F.get("evidence", F.lit(0))
    names = F.concat_ws(":", F.coalesce(F.col("subject").cast("string"), F.lit("unknown")), F.coalesce("predicate", F.lit("RELATED_TO")), F.coalesce(F.col("object").cast("string"), F.lit("unknown")))
    score = F.coalesce("confidence", F.lit(0.0)) * F.coalesce("relevance", F.lit(0.0))
    return retrieved.select("query_id", "rank", F.coalesce(first["source_id"], names).alias("source_id"), F.coalesce(first["source_kind"], F.lit("research")).alias("source_kind"), F.coalesce(first["excerpt"], F.lit("")).alias("text"), score.alias("score"), score.alias("temporal_score"), F.lit(True).alias("temporal_applied"))


def research(hits: DataFrame, queries: DataFrame, nodes: DataFrame, edges: DataFrame, links: DataFrame, evidence: DataFrame, at_us: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Research hits by the temporal graph, which baseline ``hits`` only give seeds for; and for every question its status.

    ``hits``: query_id, rank, score, project_id, entities (array of structs of name and kind). ``links``: temporal.EDGE, evidence_id.
    The status is ``temporal_graph``, ``no_baseline`` or the reason for which a required retrieval fails.
    """
    projects, seeds = projects_of_hits(hits), seeds_of_hits(hits)
    resolved = materialise(resolve_seeds(seeds.join(projects, "query_id"), nodes), "seeds")
    found = temporal_retrieve(edges, resolved, at_us, 2 * candidate_limit(limit, "web"))
    lists = evidence_lists(links, temporal.EDGE)
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"l.{c}")) for c in temporal.EDGE]
    with_ids = materialise(found.alias("f").join(lists.alias("l"), same, "left").select("f.*", "l.evidence_ids"), "retrieved")
    rows = as_research_rows(hydrate(with_ids, ["query_id", "rank"], "evidence_ids", evidence, "evidence_id", ["source_kind", "source_id", "excerpt"]))
    rows = rows.where(F.col("rank") <= limit).withColumn("retrieval_provenance", provenance("web", "temporal_graph", True, ["temporal_graph"]))
    flag = lambda df, name: df.select("query_id").distinct().withColumn(name, F.lit(True))
    status = queries.select("query_id")
    for df, name in ((hits, "hit"), (projects, "project"), (seeds, "seed"), (with_ids, "result")):
        status = status.join(flag(df, name), "query_id", "left")
    reason = F.when(F.col("hit").isNull(), "no_baseline").when(F.col("project").isNull(), "missing_project_scope").when(F.col("seed").isNull(), "no_temporal_seeds").when(F.col("result").isNull(), "empty_temporal_result").otherwise("temporal_graph")
    return rows, status.select("query_id", reason.alias("status"))


def required(rows: DataFrame, status: DataFrame, module: str) -> DataFrame:
    """``rows``, or the error of the first question whose status is a failure."""
    failed = status.where(~F.col("status").isin("temporal_graph", "no_baseline")).orderBy("query_id").limit(1).collect()
    if failed:
        raise TemporalRetrievalRequiredError(module, failed[0].status, {"query_id": failed[0].query_id})
    return rows


def conversation_tiers(temporal_hits: DataFrame, dense_hits: DataFrame, text_hits: DataFrame, limit: int) -> DataFrame:
    """Each question's turns from the first tier that has any: temporal graph, dense, text.

    All have query_id, place, session_id, turn_index, role, content, score.
    """
    tiers = [(temporal_hits, "temporal_graph"), (dense_hits, "dense_only"), (text_hits, "text_fallback")]
    rows = None
    for tier, (df, mode) in enumerate(tiers):
        own = df.select("query_id", "place", "session_id", "turn_index", "role", "score", F.lit(mode).alias("mode"), F.lit(tier).alias("tier"))
        rows = own if rows is None else rows.unionByName(own)
    best = rows.groupBy("query_id").agg(F.min("tier").alias("tier"))
    return rows.join(best, ["query_id", "tier"]).where(F.col("place") <= limit).drop("tier")


def code_search(baseline: DataFrame, edges: DataFrame, limit: int, policy: str = "auto", ppr: bool = False, max_nodes: int | None = None) -> DataFrame:
    """query_id, source_id, score, baseline_score, mode, rank: semantic hits, or these blended with a walk from them over structural edges.

    ``baseline``: query_id, node, score, rank, with ``candidate_limit`` rows a question. ``policy`` is one of POLICIES;
    auto takes the graph where ``ppr`` is set. A question none of whose hits is a node of the graph falls back.
    ``max_nodes``: the budget of a question's expansion (graph.capped_reach()); none: all within MAX_HOPS.
    """
    chosen = normalise_policy(policy, allow_auto=True)
    if chosen is None:
        raise ValueError(f"no such policy: {policy}")
    plain = baseline.select("query_id", F.col("node").alias("source_id"), "score", F.col("score").alias("baseline_score"), "rank")
    if chosen == "safe" or (chosen == "auto" and not ppr):
        return plain.where(F.col("rank") <= limit).withColumn("mode", F.lit("semantic_only"))
    edges = materialise(edges.select("src", "dst", "weight"), "edges")
    hits = materialise(baseline.select("query_id", "node", F.col("score").alias("baseline_score")), "hits")
    scored = graph.walk_within(edges, hits, MAX_HOPS, 0.2) if max_nodes is None else None
    if scored is None:
        both = edges.select(F.lit(0).alias("project_id"), F.col("src").alias("subject"), F.col("dst").alias("object"), "weight")
        both = both.union(both.select("project_id", "object", "subject", "weight"))
        seeds = hits.join(both.select(F.col("subject").alias("node")).distinct(), "node", "left_semi").select("query_id", F.lit(0).alias("project_id"), "node")
        near = graph.capped_reach(edges.select(F.lit(0).alias("project_id"), "src", "dst", "weight"), seeds, MAX_HOPS, max_nodes)
        walk = graph.inside(both, near).select("query_id", F.col("subject").alias("src"), F.col("object").alias("dst"), "weight")
        scored = materialise(near.join(graph.walk_each(walk, seeds, ["query_id"], 0.2), ["query_id", "node"], "left").select("query_id", "node", "rank"), "ranks")
    scored = scored.select("query_id", "node", F.coalesce("rank", F.lit(0.0)).alias("ppr"))
    joined = scored.join(hits, ["query_id", "node"], "left").withColumn("baseline_score", F.coalesce("baseline_score", F.lit(0.0)))
    # The largest of each question, before its rows meet them: no task has all rows of one question.
    own = materialise(joined.groupBy("query_id").agg(F.max("baseline_score").alias("most_baseline_score"), F.max("ppr").alias("most_ppr")), "own")
    joined = joined.join(own, "query_id")
    over = lambda c: F.when(F.col(f"most_{c}") > 0, F.col(c) / F.col(f"most_{c}")).otherwise(0.0)
    joined = joined.withColumn("score", F.round(0.6 * over("baseline_score") + 0.4 * over("ppr"), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("baseline_score"), "node")
    ranked = joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    ranked = ranked.select("query_id", F.col("node").alias("source_id"), "score", "baseline_score", "rank", F.lit("semantic_plus_graph_rerank").alias("mode"))
    fallback = plain.where(F.col("rank") <= limit).join(own.select("query_id"), "query_id", "left_anti").withColumn("mode", F.lit("semantic_only_fallback"))
    return ranked.unionByName(fallback)


def all_memory(hits: dict[str, DataFrame | None], queries: DataFrame, limit: int, modules: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One list of hits a question over the chosen modules, and an error row for each module that is not there.

    ``hits``: query_id, source_id, score, temporal_applied by module; None where its pipeline is unavailable.
    """
    chosen = normalise_modules(modules)
    rows = queries.select("query_id", F.lit("").alias("module"), F.lit("").alias("source_id"), F.lit(0.0).alias("score"), F.lit(False).alias("temporal_applied")).limit(0)
    gone = [m for m in chosen if hits.get(m) is None]
    for m in chosen:
        if m not in gone:
            rows = rows.unionByName(hits[m].select("query_id", F.lit(m).alias("module"), F.col("source_id").cast("string").alias("source_id"), "score", "temporal_applied"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("temporal_applied"), "module", "source_id")
    errors = queries.select("query_id", F.explode(F.array(*[F.lit(m) for m in gone]) if gone else F.array().cast("array<string>")).alias("module")).withColumn("message", F.concat("module", F.lit(" pipeline unavailable")))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit), errors
