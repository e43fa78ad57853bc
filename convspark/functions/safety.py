"""Prompt-injection detection and rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convspark import values as V
from convspark.functions.text import let

_FLAGS = "(?iU)"  # case-insensitive with Unicode word, space and case classes


def detect_flags(text: Column) -> Column:
    """Families that match the original text, in bank order."""
    hits = [F.when(text.rlike(_FLAGS + p), F.lit(flag)) for flag, p, _ in V.INJECTION_FAMILIES]
    return F.array_compact(F.array(*hits))


def has_markers(text: Column) -> Column:
    return F.coalesce(F.size(detect_flags(text)) > 0, F.lit(False))


def sanitize(text: Column, wrap: bool = True) -> tuple[Column, Column]:
    """(sanitised text, flags). Each family sees the text as rewritten by the families before it."""
    state = F.struct(F.coalesce(text, F.lit("")).alias("t"), F.array().cast("array<string>").alias("flags"))

    def rewrite(flag, pattern, replacement):
        def step(s):
            new = F.struct(
                F.regexp_replace(s["t"], _FLAGS + pattern, replacement).alias("t"),
                F.array_append(s["flags"], F.lit(flag)).alias("flags"),
            )
            return F.when(s["t"].rlike(_FLAGS + pattern), new).otherwise(s)

        return step

    for family in V.INJECTION_FAMILIES:
        state = let(state, rewrite(*family))
    body = state["t"]
    if wrap:
        marked = lambda t: F.concat(F.lit(V.BEGIN_UNTRUSTED + "\n"), t, F.lit("\n" + V.END_UNTRUSTED))
        body = let(body, lambda t: F.when(t == "", t).otherwise(marked(t)))
    return body, state["flags"]
