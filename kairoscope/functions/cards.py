"""Texts that are made of several columns: cards for rerankers, texts to embed, templates; and what embedding them costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are embedded, the mark behind a cut text, dollars for a million tokens.
EMBED_CHARS, CUT_MARK, PRICE_PER_MILLION = 24_000, "...[TRUNCATED]", 0.2


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def yaml_card(fields: list[tuple[str, Column]], lists: list[tuple[str, Column]] = []) -> Column:  # noqa: B006
    """A line for each field that has a text, a block where it has several lines, then each list with its items; null where nothing is left but empty."""
    parts = []
    for key, value in fields:
        text = _stripped(value.cast("string"))
        block = F.concat(F.lit(f"{key}: |-\n"), F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("  "), x)), "\n"))
        parts.append(F.when(text == "", None).when(F.contains(text, F.lit("\n")), block).otherwise(F.concat(F.lit(f"{key}: "), text)))
    for key, items in lists:
        kept = F.filter(F.transform(items, lambda x: _stripped(x.cast("string"))), lambda x: x != "")
        parts.append(F.when(F.size(kept) > 0, F.concat(F.lit(f"{key}:\n"), F.array_join(F.transform(kept, lambda x: F.concat(F.lit("  - "), x)), "\n"))))
    return F.concat_ws("\n", *parts)


def code_context(path: Column, class_name: Column, function: Column, code: Column) -> Column:
    """The text to embed of a piece of code: of a class (function null), of a method, or of a function (class null)."""
    of_class = F.concat(F.lit("Context: File "), path, F.lit(" > Class "), class_name)
    of_method = F.concat(F.lit("Context: File: "), path, F.coalesce(F.concat(F.lit(" > Class: "), class_name), F.lit("")), F.lit(" > Method: "), function)
    return F.concat(F.when(function.isNull(), of_class).otherwise(of_method), F.lit("\n\n"), code)


def memory_text(name: Column, kind: Column, observations: Column) -> Column:
    """The text to embed of a memory entity."""
    seen = F.when(F.size(observations) > 0, F.concat(F.lit("\nObservations:\n- "), F.array_join(observations, "\n- ")))
    return F.concat(F.lit("Name: "), name, F.lit("\nType: "), kind, F.coalesce(seen, F.lit("")))


def observation_text(observations: Column) -> Column:
    """The observations that are not blank, a line each."""
    return F.array_join(F.filter(F.transform(observations, _stripped), lambda x: x != ""), "\n")


def embed_input(text: Column) -> Column:
    """A text as it is embedded: cut, in one line."""
    cut = F.when(F.length(text) > EMBED_CHARS, F.concat(F.substring(text, 1, EMBED_CHARS), F.lit(CUT_MARK))).otherwise(text)
    return F.replace(cut, F.lit("\n"), F.lit(" "))


def zero_vector(size: int) -> Column:
    """What stands for an embedding where there is no provider."""
    return F.array_repeat(F.lit(0.0), size)


def embedding_cost(tokens: Column) -> Column:
    """Dollars for so many tokens; unknown for unknown tokens."""
    return tokens.cast("double") * (PRICE_PER_MILLION / 1e6)


def filled(template: Column, values: Column) -> Column:
    """``{key}`` replaced by its value for each entry of a map; what the map lacks stays."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
