"""Output token budgets of a model call, from the budget of the call before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first budget, the context, and what a growing budget leaves room for.
FIRST, CONTEXT, MARGIN, FLOOR, CHARS_PER_TOKEN = 2048, 16384, 256, 512, 4


def within_context(last: Column, prompt: Column) -> Column:
    """Twice the last budget, within what the prompt leaves of the context, FLOOR at least; FIRST at first."""
    room = F.lit(CONTEXT - MARGIN) - F.floor(F.length(prompt) / CHARS_PER_TOKEN)
    return F.when(last > 0, F.greatest(F.lit(FLOOR), F.least(2 * last, room))).otherwise(FIRST).cast("bigint")


def doubled(last: Column) -> Column:
    """Twice the last budget, CONTEXT at most; FIRST at first."""
    return F.when(last > 0, F.least(2 * last, F.lit(CONTEXT))).otherwise(FIRST).cast("bigint")
