"""Lanes: dealing messages to slots, bringing slots together, and combining sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..message import with_seq


def split_round_robin(df: DataFrame, slots: int) -> DataFrame:
    """The first message to slot 0, the next to slot 1, and so on round; more than one slot."""
    if slots < 2:
        raise ValueError("a splitter needs more than one slot")
    if df.isStreaming and "seq" not in df.columns:
        from ..streaming.stateful import numbered

        df = numbered(df)
    return df.withColumn("slot", F.pmod("seq", F.lit(slots)).cast("int"))


def merge(df: DataFrame) -> DataFrame:
    """All slots as one, in the order of seq, which stays."""
    return df.withColumn("slot", F.lit(0))


def between_stages(df: DataFrame, from_slots: int, to_slots: int) -> DataFrame:
    """Slots from stage to stage without a splitter: slot i feeds slot i modulo the next stage's."""
    if from_slots < 1 or to_slots < 1:
        raise ValueError("a stage needs one slot at least")
    return df.withColumn("slot", F.pmod("slot", F.lit(to_slots)).cast("int"))


def combine(first: DataFrame, *others: DataFrame, source_ids: list[str] | None = None, reorder: tuple[str, ...] = ()) -> DataFrame:
    """The union of sources of one payload type; ``source_ids`` name them, in order.

    Each source brings its slot 0 only, and all arrive in slot 0. ``reorder`` gives bounded sources
    one new seq by these columns; without it seq is each source's own. Of streams none is kept, as
    messages of several sources have no order but that of arrival. Columns that a source lacks are null.
    """
    slotted = [s if "slot" in s.columns else s.withColumn("slot", F.lit(0)) for s in (first, *others)]
    sources = [slotted[0], *[o.filter("slot = 0") for o in slotted[1:]]]
    if any(s.isStreaming for s in sources):
        sources = [s.drop("seq") for s in sources]
    if source_ids:
        sources = [s.withColumn("source_id", F.lit(name)) for s, name in zip(sources, source_ids, strict=True)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("slot", F.lit(0)) for s in sources])
    return with_seq(both.drop("seq"), *reorder) if reorder else both
