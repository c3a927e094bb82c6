"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask names the word positions of a window that are hashed; the others are ignored, so a hit
survives substitutions there. The seeds of all documents are joined with the seeds of the
benchmark; each hit gives a diagonal (document position minus item position), on which the whole
item is compared word by word. A document is contaminated by an item if some stretch of
``window`` item words (all words of a shorter item) has at least ``share`` equal words there.

Every pattern that the default window and share accept holds a seed of ``SEEDS``, as a test
enumerates: items of more than ``SHORT`` words are searched for by the first masks, shorter ones by
the masks of their number of words, which documents are seeded with only where such items exist.

Words are lower-cased runs without white space and ASCII punctuation. Null and empty texts have
none and are never reported, nor are rows without an id. Repeated rows give one row per pair of ids;
of several texts with one id the best overlap counts. A text of any length is searched whole. Other
columns are not read; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.joins import SALT, blocks_of, copied, dealt, salted_join, small, without
from kairoscope.session import materialise

#: Hashed word positions of the search: a mask, and the fewest and most words of the items that it is for (None: any more).
SHORT = 8
SEEDS = (((0, 1, 2, 4), SHORT + 1, None), ((0, 3, 4, 5), SHORT + 1, None), ((0,), 1, 1), ((0, 1), 2, 2), ((0, 1, 2), 3, SHORT), ((0, 1, 3), 4, SHORT), ((0, 2, 3), 4, 4))
WINDOW, SHARE = 20, 0.75
#: Words up to which an item has no other match than all of its words, which its seed covers.
ALL_WORDS = 3
#: Hits of a document beyond which they are dealt to several tasks.
HOT_HITS = 10_000
SPLIT = r"[\t-\r \p{Punct}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPLIT), "")


def _exploded(rows: DataFrame, key: str, chosen: tuple[tuple[int, tuple[int, ...], Column], ...]) -> DataFrame:
    """key, seed, position at all positions; chosen: number, mask and which rows it is for."""
    size, empty = F.size("hashes"), F.array().cast("array<struct<seed:bigint,position:int>>")

    def of(number: int, mask: tuple[int, ...], rows_for: Column) -> Column:
        starts = F.when(rows_for & (size > max(mask)), F.sequence(F.lit(0), size - max(mask) - 1))
        found = F.transform(starts, lambda i: F.struct(F.xxhash64(F.lit(number), *[F.get(F.col("hashes"), i + o) for o in mask]).alias("seed"), i.alias("position")))
        return F.coalesce(found, empty)

    return rows.select(key, F.explode(F.concat(*[of(*c) for c in chosen])).alias("at")).select(key, "at.seed", "at.position")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", masks: tuple[tuple[tuple[int, ...], int, int | None], ...] = SEEDS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """A row for each document and item that overlap: ids, start (first word of the diagonal), window, matched, n_equal."""
    hashed = hashed_of("text")
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL")
    items = benchmark.select(F.col(item_col).alias("item"), hashed_of(text_col).alias("hashes")).where("item IS NOT NULL")
    size = F.size("hashes")
    sizes = [r.n for r in items.select(F.least(size, F.lit(SHORT + 1)).alias("n")).distinct().collect()]
    used = [(i, m, least, most) for i, (m, least, most) in enumerate(masks) if any(least <= n and (most is None or n <= most) for n in sizes)]
    if not used:
        used = [(0, *masks[0])]
    chosen = tuple((i, m, (size >= least) & (size <= (most or 1 << 30))) for i, m, least, most in used)
    item_seeds = _exploded(items, "item", chosen).withColumnRenamed("position", "item_position")
    item_seeds = materialise(item_seeds.join(items.select("item", (size <= ALL_WORDS).alias("whole")), "item"), "item-seeds")
    doc_seeds = _exploded(texts.select("doc", hashed.alias("hashes")), "doc", tuple((i, m, F.lit(True)) for i, m, *_ in used))
    found = salted_join(doc_seeds, item_seeds, "seed", F.col("doc"), how="inner").select("doc", "item", "whole", (F.col("position") - F.col("item_position")).alias("diagonal"))
    # All places of a short item are equally good, so that the first of a document stands for them.
    hits = found.groupBy("doc", "item", F.when(~F.col("whole"), F.col("diagonal")).alias("at")).agg(F.min("diagonal").alias("diagonal")).drop("at")
    hits = materialise(hits, "seed-hits")  # counted, and then joined with the texts
    hot = blocks_of(hits, "doc", HOT_HITS)
    pairs = copied(texts, hot, "doc").join(small(dealt(hits, hot, "doc", F.struct("item", "diagonal"))), ["doc", SALT]).select("doc", "item", "diagonal", hashed.alias("doc_hashes"))
    pairs = pairs.join(items.select("item", F.col("hashes").alias("item_hashes")), "item")
    n = F.size("item_hashes")
    equal = F.transform(F.col("item_hashes"), lambda h, j: F.when(F.get(F.col("doc_hashes"), j + F.col("diagonal")) == h, 1).otherwise(0))
    rows = pairs.select("doc", "item", "diagonal", n.alias("n"), F.least(n, F.lit(window)).alias("window"), equal.alias("equal"))
    best = F.expr("array_max(transform(sequence(0, n - window), s -> aggregate(slice(equal, s + 1, window), 0, (a, x) -> a + x)))")
    rows = rows.select("doc", "item", "diagonal", "window", best.alias("matched"), F.expr("aggregate(equal, 0, (a, x) -> a + x)").alias("n_equal"))
    kept = rows.where(F.col("matched") >= F.ceil(F.col("window") * share))
    top = kept.groupBy("doc", "item").agg(F.max(F.struct("matched", "n_equal", (-F.col("diagonal")).alias("back"), "window")).alias("top"))
    return top.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), (-F.col("top.back")).cast("long").alias("start"), F.col("top.window").cast("long").alias("window"), F.col("top.matched").cast("long").alias("matched"), F.col("top.n_equal").cast("long").alias("n_equal"))


def hashed_of(text_col: str) -> Column:
    return F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that overlap any item."""
    found = find_overlaps(docs, benchmark, id_col, text_col=text_col).select(id_col).distinct()
    return without(docs, materialise(found, "contaminated"), id_col, F.col(text_col))


def oracle_sql(window: int = WINDOW, share: float = SHARE) -> str:
    """find_overlaps() over documents and benchmark in DuckDB's SQL, without hashes."""
    parts = []
    for i, (mask, least, most) in enumerate(SEEDS):
        key = " || ' ' || ".join(f"w[p + {o + 1}]" for o in mask)
        span = max(mask) + 1
        for table, key_col in (("d", "doc_id"), ("b", "item_id")):
            rows = f"len(w) >= {span}" if table == "d" else f"len(w) BETWEEN {least} AND {most or 1 << 30}"
            parts.append((table, f"SELECT {key_col}, p, '{i}:' || {key} AS seed FROM (SELECT *, unnest(range(len(w) - {span - 1})) AS p FROM {table} WHERE {rows})"))
    doc_seeds = " UNION ALL ".join(s for t, s in parts if t == "d")
    item_seeds = " UNION ALL ".join(s for t, s in parts if t == "b")
    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\t-\r [:punct:]]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {split} AS w FROM documents), b AS (SELECT item_id, {split} AS w FROM benchmark),
ds AS ({doc_seeds}), bs AS ({item_seeds}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS diagonal FROM ds JOIN bs USING (seed)),
words AS (
  SELECT doc_id, item_id, diagonal, len(b.w) AS n, least(len(b.w), {window}) AS window_,
         list_transform(range(len(b.w)), lambda j: CASE WHEN j + diagonal >= 0 AND d.w[j + diagonal + 1] = b.w[j + 1] THEN 1 ELSE 0 END) AS equal
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
), scored AS (
  SELECT doc_id, item_id, diagonal, window_, list_sum(equal) AS n_equal,
         list_max(list_transform(range(n - window_ + 1), lambda s: list_sum(equal[s + 1 : s + window_]))) AS matched FROM words
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, n_equal DESC, diagonal) AS r
  FROM scored WHERE matched >= ceil(window_ * {share})
)
SELECT doc_id, item_id, diagonal::BIGINT AS start, window_::BIGINT AS "window", matched::BIGINT AS matched, n_equal::BIGINT AS n_equal FROM ranked WHERE r = 1
"""
