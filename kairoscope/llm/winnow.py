"""Document fingerprints by winnowing, in DataFrame operations only.

Units are the words (runs without white space) of at most ``PIECE`` code points, and each code point
of a longer run, so that text without spaces has units too. Every ``K`` units in a row have a rolling
hash, a cyclic polynomial of their hashes. Of each ``WINDOW`` hashes in a row the smallest is chosen,
the rightmost of equal ones, and kept with its position. Two texts that share ``K + WINDOW - 1`` units
in a row therefore share a chosen hash, and nothing shorter than ``K`` units is ever matched. A text
with fewer units than K has one hash of all of them; one with fewer hashes than a window, the smallest.

Null and empty texts have no units and an empty fingerprint; two empty fingerprints are alike (1),
an empty and another are not (0). A text of any length has its whole fingerprint, in one row. Equal
texts have equal fingerprints. Repeated rows keep their rows; among equal ids the text gives the
order. A row without an id has no place in the order: the text next to it is its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW, PIECE = 4, 5, 16
#: A run of neighbouring ids of 2**6 is put in order by one task; then, of the runs, 2**12 at a time.
_BLOCK_BITS, _LEVEL_BITS = 6, 12


def unit_hashes(text: Column) -> Column:
    units = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(rf"(?<![^\t-\r ])[^\t-\r ]{{1,{PIECE}}}(?![^\t-\r ])|[^\t-\r ]"), F.lit(0))
    return F.transform(units, lambda u: F.xxhash64(u))


def turned(h: Column, bits: int) -> Column:
    """The 64 bits of h turned to the left."""
    bits %= 64
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)) if bits else h


def _joined(units: str, last: str, size: int, more: int) -> Callable[[Column], Column]:
    """The window of ``more`` units at i from two of ``size``, and the unit behind them if there is one more."""

    def at(i: Column) -> Column:
        h = turned(F.get(last, i), size).bitwiseXOR(F.get(last, i + size))
        return turned(h, 1).bitwiseXOR(F.get(units, i + 2 * size)) if more > 2 * size else h

    return at


def rolled(df: DataFrame, units: str, name: str, k: int = K) -> DataFrame:
    """``df`` with the array ``name``: the cyclic polynomial of each k units in a row, from those of half as many; fewer units have one of all, none have none.

    Turning all hashes by a bit and adding a unit (without carry) is what a window does when it rolls on; of two
    neighbouring windows, the first is turned by the length of the second. ``units`` is read in loops, so it is a stored column.
    """
    steps, size, last = [k], 1, units
    while steps[-1] > 1:
        steps.append(steps[-1] // 2)
    for more in steps[-2::-1]:
        here = f"__{name}_{more}"
        rows = F.transform(F.sequence(F.lit(0), F.size(units) - more), _joined(units, last, size, more))
        df = df.withColumn(here, F.when(F.size(units) >= more, rows).otherwise(F.array().cast("array<long>")))
        if last != units:
            df = df.drop(last)
        last, size = here, more
    short = F.aggregate(units, F.lit(0).cast("long"), lambda h, u: turned(h, 1).bitwiseXOR(u))
    whole = F.when(F.size(units) >= k, F.col(last)).when(F.size(units) > 0, F.array(short)).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(name, whole)
    return df if last == units else df.drop(last)


def smallest(hashes: str, window: int = WINDOW) -> Column:
    """The smallest of each ``window`` hashes in a row, or of all fewer ones."""
    slid = F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.least(*[F.get(hashes, i + j) for j in range(window)]))
    few = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<long>"))
    return F.when(F.size(hashes) >= window, slid).otherwise(few)


def chosen_positions(hashes: str, least: str, window: int = WINDOW) -> Column:
    """Of each window the last position that holds its smallest hash, each position once and in order. Both columns are read in loops, so they are stored."""

    def last_of(m: Column, i: Column) -> Column:
        found = i
        for j in range(1, window):
            found = F.when(F.get(hashes, i + j) == m, i + j).otherwise(found)
        return found

    return F.array_distinct(F.transform(least, last_of))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with array columns ``name``_hashes and ``name``_positions. Each step is a column, so that it is worked out once."""
    a, b, m, c = f"__{name}_units", f"__{name}_grams", f"__{name}_least", f"{name}_positions"
    out = rolled(df.withColumn(a, unit_hashes(text)), a, b).drop(a)
    out = out.withColumn(m, smallest(b))
    out = out.withColumn(c, chosen_positions(b, m)).drop(m)
    return out.withColumn(f"{name}_hashes", F.transform(F.col(c), lambda p: F.get(F.col(b), p))).drop(b)


def as_text(hashes: Column, positions: Column) -> Column:
    """Position and hash of each choice: ``12:9af0...``."""
    return F.concat_ws(" ", F.zip_with(hashes, positions, lambda h, p: F.concat_ws(":", p.cast("string"), F.lower(F.hex(h)))))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared distinct hashes over the sum of both numbers of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, hashes array<long> and positions array<int> of every row."""
    rows = with_fingerprint(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), F.col("__text"), "fp")
    return rows.select(F.col("__id").alias(id_col), F.col("fp_hashes").alias("hashes"), F.col("fp_positions").alias("positions"))


def next_in_order(keys: DataFrame, key: str) -> DataFrame:
    """key, next: the next larger value of distinct long keys, null after the last.

    Keys that share their upper bits are ordered by one task, at most 2**12 of them; the last of each
    such run finds the first key of the next run in the same way, one level up. Four levels bring 58
    bits down to 10, so the last window holds at most 2**10 rows, whatever the keys.
    """

    def level(rows: DataFrame, depth: int) -> DataFrame:
        if depth == 4:
            return rows.select("k", F.lead("first").over(Window.orderBy("k")).alias("next"))
        upper = rows.withColumn("u", F.shiftright("k", _LEVEL_BITS))
        inside = upper.select("k", "u", F.lead("first").over(Window.partitionBy("u").orderBy("k")).alias("next"))
        runs = level(upper.groupBy("u").agg(F.min("first").alias("first")).withColumnRenamed("u", "k"), depth + 1)
        runs = runs.select(F.col("k").alias("u"), F.col("next").alias("later"))
        return inside.join(runs, "u", "left").select("k", F.coalesce("next", "later").alias("next"))

    return level(keys.select(F.col(key).alias("k"), F.col(key).alias("first")), 0).select(F.col("k").alias(key), "next")


def edited_against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, its fingerprint, the next text's, and that of the text whose second half the next text's start replaces.

    Columns: id, n_chars, edited, fp_*, edited_fp_*, next_hashes. The text after the last is the first.
    """
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = every.where("id IS NOT NULL").withColumn("block", F.shiftright("id", _BLOCK_BITS))
    in_order = Window.partitionBy("block").orderBy("id", "text")
    # Blocks are ordered among themselves by their numbers alone; only each block's first text moves a second time.
    blocks = rows.select("block").distinct()
    following = next_in_order(blocks, "block")
    first_block = blocks.agg(F.min("block").alias("first_block"))
    following = following.crossJoin(F.broadcast(first_block)).select(F.col("block"), F.coalesce("next", "first_block").alias("later"))
    firsts = rows.groupBy("block").agg(F.min(F.struct("id", "text")).alias("first")).select(F.col("block").alias("later"), F.col("first.text").alias("first_text"))
    later = following.join(firsts, "later").select("block", "first_text")
    rows = rows.withColumn("next_text", F.lead("text").over(in_order))
    rows = with_fingerprint(rows, F.col("text"), "fp")
    rows = rows.withColumn("next_hashes", F.lead("fp_hashes").over(in_order))
    inner = rows.where("next_text IS NOT NULL")
    ends = rows.where("next_text IS NULL").drop("next_text", "next_hashes").join(later, "block", "left").withColumnRenamed("first_text", "next_text")
    ends = with_fingerprint(ends, F.col("next_text"), "next").drop("next_positions")
    alone = with_fingerprint(every.where("id IS NULL").withColumn("next_text", F.col("text")), F.col("text"), "fp").withColumn("next_hashes", F.col("fp_hashes"))
    both = inner.drop("block").unionByName(ends.drop("block")).unionByName(alone)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    return with_fingerprint(both, F.col("edited"), "edited_fp").select("id", "n_chars", "edited", "fp_hashes", "fp_positions", "edited_fp_hashes", "edited_fp_positions", "next_hashes")


def digest(edited: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return edited.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp_hashes"), F.col("fp_positions")).alias("fingerprint"),
        as_text(F.col("edited_fp_hashes"), F.col("edited_fp_positions")).alias("edited_fingerprint"),
        likeness(F.col("fp_hashes"), F.col("edited_fp_hashes")).alias("near_edited"),
        likeness(F.col("fp_hashes"), F.col("next_hashes")).alias("near_next"),
    )
