"""Links between sets of tokens that share index entries, compared whole.

Of the sets that share an entry, first all are compared with one central member; then only those
pairs whose members are still in different components and which the overlaps with the centre do not
rule out. So no link between two components is lost, and a large group costs a star. Keys with many
rows are dealt to several tasks by blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.components import connected_components
from kairoscope.llm.joins import blocks_of, copied, dealt, release_shuffles, small
from kairoscope.session import materialise

#: Pairs of one document, and open rows of one entry, beyond which they are dealt to several tasks.
HOT_PAIRS, HOT_ROWS = 200, 500


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb and the number of tokens that the whole sets (doc, n, tokens) share."""
    own = lambda c: sets.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))
    by_b = blocks_of(pairs, "b", HOT_PAIRS)
    with_b = small(dealt(pairs, by_b, "b", F.col("a"))).join(copied(own("b"), by_b, "b"), ["b", "__salt"]).drop("__salt")
    by_a = blocks_of(pairs, "a", HOT_PAIRS)
    both = dealt(with_b, by_a, "a", F.col("b")).join(copied(own("a"), by_a, "a"), ["a", "__salt"])
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("shared"))


def pairs_within(rows: DataFrame, key: str, condition: Callable[[str, str], Column]) -> DataFrame:
    """a, b: pairs of rows with the same key and another ``part`` for which ``condition`` (of the prefixes of both sides) holds.

    The rows of a hot key are dealt to several tasks. Only those outside its largest part are copied to each of
    them, as the rows of that part have no pairs among themselves: a group of copies with a few others costs these
    few times the group.
    """
    blocks = blocks_of(rows, key, HOT_ROWS)
    sizes = rows.join(blocks, key).groupBy(key, "part", "__parts").agg(F.count("*").alias("__rows"))
    blocks = small(materialise(sizes.groupBy(key, "__parts").agg(F.max_by("part", F.struct("__rows", "part")).alias("__main")), "hot"))
    in_main = F.coalesce(F.col("part") == F.col("__main"), F.lit(False))
    x = copied(rows.join(blocks.select(key, "__main"), key, "left").where(~in_main).drop("__main"), blocks.drop("__main"), key).alias("x")
    y = dealt(rows, blocks.drop("__main"), key, F.col("doc")).join(blocks.select(key, "__main"), key, "left").withColumn("__in_main", in_main).drop("__main").alias("y")
    together = (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.__salt") == F.col("y.__salt")) & (F.col("x.part") != F.col("y.part"))
    once = F.col("y.__in_main") | (F.col("x.doc") < F.col("y.doc"))
    return x.join(y, together & once & condition("x.", "y.")).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))


def entry_links(indexed: DataFrame, sets: DataFrame, percent: int, likely: Callable[[str, str], Column] | None = None) -> DataFrame:
    """a, b: links that connect all sets which share an entry and are linked.

    ``indexed`` has entry, doc, n (tokens of the set), s (those of them that any other may have), central (the
    larger, the likelier a centre) and what ``likely``, a condition that every link meets, asks of both sides.
    """
    # The entries of a group of copies mostly have the same centre.
    extra = [c for c in indexed.columns if c not in ("entry", "doc", "n", "s", "central")]
    hubs = indexed.groupBy("entry").agg(F.max_by(F.struct("doc", "n", "s", *extra), F.struct("central", (-F.col("doc")).alias("d"))).alias("hub"))
    hubs = hubs.select("entry", "hub.*").alias("x")
    stars = indexed.alias("y").join(hubs, F.col("x.entry") == F.col("y.entry")).where(F.col("x.doc") != F.col("y.doc"))
    if likely:
        stars = stars.where(likely("x.", "y."))
    stars = stars.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    stars = materialise(overlaps(materialise(stars, "stars"), sets), "overlaps")
    links = materialise(stars.where(is_link(percent)).select("a", "b"), "links")
    release_shuffles(indexed.sparkSession)
    # Only entries that still hold several components have more to tell, and of them only pairs that their
    # overlaps with a common centre do not rule out.
    fans = stars.groupBy("a").agg(F.count("*").alias("fans"))
    to_hub = stars.join(fans, "a").groupBy("b").agg(F.max(F.struct("fans", (-F.col("a")).alias("d"), "shared")).alias("top")).select(F.col("b").alias("doc"), (-F.col("top.d")).alias("hub"), F.col("top.shared").alias("in_hub"))
    open_rows = materialise(_still_open(indexed, links).join(to_hub, "doc", "left"), "open")

    def possible(x: str, y: str) -> Column:
        near = _near(x, y, percent)
        return near & likely(x, y) if likely else near

    same_hub = lambda x, y: F.coalesce(F.col(f"{x}hub") == F.col(f"{y}hub"), F.lit(False))
    enough_inside = lambda x, y: _reaches(F.least(f"{x}in_hub", f"{y}in_hub"), x, y, percent)
    rest = pairs_within(open_rows, "entry", lambda x, y: possible(x, y) & (~same_hub(x, y) | enough_inside(x, y)))

    # Two sets that share too little within their common centre have to share a token outside of it.
    def beside(x: str, y: str) -> Column:
        most = F.least(f"{x}in_hub", f"{y}in_hub") + F.least(F.col(f"{x}s") - F.col(f"{x}in_hub"), F.col(f"{y}s") - F.col(f"{y}in_hub"))
        return same_hub(x, y) & possible(x, y) & ~enough_inside(x, y) & _reaches(most, x, y, percent)

    outside = materialise(_outside_centre(open_rows.drop("entry").where("hub IS NOT NULL").distinct(), sets), "outside")
    rest = materialise(rest.union(pairs_within(outside, "token", beside)).distinct(), "rest")
    rest = materialise(overlaps(rest, sets), "overlaps")
    return links.union(rest.where(is_link(percent)).select("a", "b"))


def _outside_centre(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` once for each token that their centre lacks."""
    own = sets.select("doc", F.col("tokens").alias("own"))
    centres = sets.select(F.col("doc").alias("hub"), F.col("tokens").alias("centre"))
    blocks = blocks_of(rows, "hub", HOT_PAIRS)
    with_own = dealt(rows.join(own, "doc"), blocks, "hub", F.col("doc"))
    both = with_own.join(copied(centres, blocks, "hub"), ["hub", "__salt"]).drop("__salt")
    return both.withColumn("token", F.explode(F.array_except("own", "centre"))).drop("own", "centre")


def _reaches(shared: Column, x: str, y: str, percent: int) -> Column:
    """Whether two sets with so many tokens in common are linked."""
    return (100 + percent) * shared >= percent * (F.col(f"{x}n") + F.col(f"{y}n"))


def is_link(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))


def _near(x: str, y: str, percent: int) -> Column:
    """Whether the sizes (n), and the numbers of tokens that are shared with anyone (s), allow a link at all."""
    n = F.col(f"{x}n") + F.col(f"{y}n")
    return (100 * F.least(f"{x}n", f"{y}n") >= percent * F.greatest(f"{x}n", f"{y}n")) & ((100 + percent) * F.least(f"{x}s", f"{y}s") >= percent * n)


def _still_open(indexed: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of the entries that hold several components of the links so far."""
    owned = indexed.join(connected_components(links), F.col("doc") == F.col("node"), "left").drop("node", "central").withColumn("part", F.coalesce("component", "doc")).drop("component")
    split = owned.groupBy("entry").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("entry")
    return owned.join(split, "entry")
