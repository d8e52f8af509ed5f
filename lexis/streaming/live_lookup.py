"""Look-up on streams: each micro-batch is joined to the static dictionary and ranked like a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexis.operators import lookup
from lexis.steps import Steps


def start(texts: DataFrame, words: DataFrame, names: DataFrame | None, rules: list[tuple], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Look up the words of a streaming ``texts`` (text); ``sink`` takes each batch's ranked hits and its number.

    Ranking windows need whole inputs, which a micro-batch has, so they run inside foreachBatch; a batch that is repeated after a failure
    has the same number and the same hits."""

    def batch(rows: DataFrame, number: int) -> None:
        steps = Steps(rows.sparkSession)
        sink(lookup.lookup(lookup.tokens(rows.select("text")), words, names, rules, kept=steps), number)
        steps.discard()

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
