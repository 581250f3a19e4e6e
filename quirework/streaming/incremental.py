"""Stages as streams: items are worked off exactly once, mentions are linked as they arrive, state follows a log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.linking import LINK_SCHEMA, SIMILAR, Book
from ..operators.state import latest_state


def run_stage(items: DataFrame, stage: str, work: Callable[[DataFrame], DataFrame], data: str, log: str, checkpoint: str) -> StreamingQuery:
    """Work off a stream of items (item_id and others), one micro-batch at a time.

    A batch's output is a folder of its own that is overwritten if the batch runs again, and it is
    written before the log says completed; so a crash repeats a batch and doubles nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.dropDuplicates(["item_id"])
        work(df).write.mode("overwrite").parquet(f"{data}/batch={number}")
        done = df.select(F.lit(stage).alias("stage"), F.col("item_id"), F.lit("completed").alias("status"), F.lit(number).cast("long").alias("at"), F.lit(None).cast("string").alias("error_message"), F.lit(number).cast("long").alias("seq"))
        done.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_state(spark, log: str) -> DataFrame:
    """The state that a stage's log says."""
    return latest_state(spark.read.parquet(log).drop("batch"))


def link_mentions(mentions: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(book_id, ord, entity_id, how) for a stream of mentions: a book's entities are its state."""

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = Book(similar)
        if state.exists:
            for e in json.loads(state.get[0]):
                book.known(e)
        new = pd.concat(list(batches)).sort_values("ord")
        rows = [(key[0], m.ord, *(lambda e, how: (e["entity_id"], how))(*book.add(m))) for m in new.itertuples(index=False)]
        state.update((json.dumps(book.entities),))
        yield pd.DataFrame(rows, columns=["book_id", "ord", "entity_id", "how"])

    return mentions.groupBy("book_id").applyInPandasWithState(step, LINK_SCHEMA, "entities string", "append", GroupStateTimeout.NoTimeout)
