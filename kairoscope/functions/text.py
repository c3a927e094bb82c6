"""Normalisers, chunking and token estimates as column expressions. Null in, null out unless stated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the chunker: words in a window, words between window starts, token limit, tokens per word.
WINDOW_WORDS, WINDOW_STEP, CHUNK_TOKENS, TOKENS_PER_WORD = 393, 355, 512, 1.3


def name_norm(c: Column) -> Column:
    """Trimmed, lower-cased, inner white space as one blank."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " "))


def predicate_norm(c: Column) -> Column:
    """Upper-cased with underscores; other characters go."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s-]+", "_"), "[^A-Z0-9_]", "")


def relation_type(c: Column) -> Column:
    """predicate_norm(), with REFERENCES for what is empty or null."""
    norm = predicate_norm(F.coalesce(c, F.lit("")))
    return F.when(norm == "", "REFERENCES").otherwise(norm)


def memory_label(c: Column) -> Column:
    """Letters, digits and single underscores; a leading digit gets the prefix ``Type_``."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), "_+", "_"), "^_|_$", "")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("Type_"), clean)).otherwise(clean)


def memory_relation(c: Column) -> Column:
    """Upper-cased relation type; a leading digit gets ``REL_``; an empty one raises."""
    clean = F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), "_+", "_"), "^_|_$", ""))
    fixed = F.when(clean.rlike("^[0-9]"), F.concat(F.lit("REL_"), clean)).otherwise(clean)
    return F.when(clean == "", F.raise_error(F.lit("a relation type is empty"))).otherwise(fixed)


def words(c: Column) -> Column:
    """Runs without white space; none for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"\s+"), "")


def token_estimate(c: Column) -> Column:
    """int(words * 1.3)."""
    return (F.size(words(c)) * F.lit(TOKENS_PER_WORD)).cast("int")


def char_token_estimate(c: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int"))


def plugin_token_estimate(c: Column) -> Column:
    """A quarter of the characters rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int"))


def header_sections(markdown: Column) -> Column:
    """The trimmed, non-empty sections that ``##`` and ``###`` lines start; other headers do not split."""
    parts = F.split(F.coalesce(markdown, F.lit("")), r"(?m)(?=^#{2,3}\s)")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_windows(text: Column) -> Column:
    """The text itself if its token estimate fits, else overlapping windows of its words."""
    whole = F.array(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))

    def cut(w: Column) -> Column:
        count = F.ceil(F.greatest(F.size(w) - WINDOW_WORDS, F.lit(0)) / F.lit(float(WINDOW_STEP))).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda k: F.array_join(F.slice(w, k * WINDOW_STEP + 1, WINDOW_WORDS), " "))

    return once(words(text), lambda w: F.when((F.size(w) * F.lit(TOKENS_PER_WORD)).cast("int") <= CHUNK_TOKENS, whole).otherwise(cut(w)))


def lexical_terms(c: Column) -> Column:
    """Distinct lower-cased ASCII terms of more than two characters, in order of appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 2))


def contains_ignoring_case(haystack: Column, needle: Column) -> Column:
    return F.contains(F.lower(haystack), F.lower(needle))


def source_id_parts(c: Column) -> Column:
    """The session before the last colon and the turn's index behind it; null where there is no colon or no number behind it."""
    index = F.regexp_extract(c, "^(.*):([+-]?[0-9]+)$", 2).try_cast("int")
    return F.when(index.isNotNull(), F.struct(F.regexp_extract(c, "^(.*):([^:]*)$", 1).alias("session_id"), index.alias("turn_index")))


def excerpt(c: Column, length: int = 300) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, length)


def truncate_output(c: Column, length: int = 8000) -> Column:
    """Cut with a notice where longer."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("\n... [truncated]"))).otherwise(c)


def rel_path(c: Column) -> Column:
    """Forward slashes, trimmed."""
    return F.trim(F.replace(c, F.lit("\\"), F.lit("/")))


def split_message(c: Column) -> Column:
    """Subject (first line) and body of a commit message."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    body = F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "\n"), r"^\s+|\s+$", "")
    return F.struct(F.trim(F.element_at(lines, 1)).alias("subject"), F.when(F.size(lines) > 1, body).otherwise("").alias("body"))


def row_key(signature: Column, path: Column, name: Column) -> Column:
    """The first of the three that is not empty."""
    return F.trim(F.coalesce(F.nullif(signature, F.lit("")), F.nullif(path, F.lit("")), name))


def embed_text(entities: Column, text: Column) -> Column:
    """The text behind its entities; ``entities`` is array<struct<name, type>>."""
    listed = F.array_join(F.transform(entities, lambda e: F.concat(e["name"], F.lit(" ("), e["type"], F.lit(")"))), ", ")
    return F.when(F.size(entities) > 0, F.concat(F.lit("Context: "), listed, F.lit("\n\n"), text)).otherwise(text)


def import_specifier(c: Column) -> Column:
    """A script import without quotes, query and fragment."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "^['\"]|['\"]$", ""), "[?#].*$", "")
