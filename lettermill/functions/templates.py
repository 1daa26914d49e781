"""Template filling and chat markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import CHAT_MARKERS


def fill(template: str | Column, **values: Column) -> Column:
    """Replace ``{name}`` slots literally, all at once.

    The template is cut at its slots and put together again with the values,
    so braces inside an inserted value are never read as slots.
    """
    if isinstance(template, Column):
        if len(values) != 1:
            raise ValueError("a column template takes exactly one slot")
        ((name, value),) = values.items()
        return F.replace(template, F.lit("{" + name + "}"), value)
    pieces: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not found:
            break
        at, name = min(found)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(values[name])
        rest = rest[at + len(name) + 2 :]
    if rest or not pieces:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def chat_markers(model_name: str | Column) -> dict[str, Column]:
    """The four markers of a model family, chosen by a substring of its name."""
    name = F.lower(F.lit(model_name) if isinstance(model_name, str) else model_name)

    def pick(slot: int) -> Column:
        chosen = F
        for family, markers in CHAT_MARKERS.items():
            chosen = chosen.when(F.contains(name, F.lit(family)), F.lit(markers[slot]))
        return chosen.otherwise(
            F.raise_error(F.concat(F.lit("no chat markers for model "), name)).cast("string")
        )

    return {
        slot: pick(i)
        for i, slot in enumerate(
            ("prompt_start", "prompt_end", "response_start", "response_end")
        )
    }
