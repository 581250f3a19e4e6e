"""State of stages and items as an append-only log: what is pending, what is done, what falls with a rerun."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: stages in order, each with those that use its output.
DOWNSTREAM = {"glossary_build": ("glossary_cluster", "glossary_reconcile"), "glossary_cluster": ("glossary_reconcile",)}
STATUSES = ("pending", "started", "completed", "failed")


def latest_state(log: DataFrame) -> DataFrame:
    """(stage, item_id, status, completed_at, error_message): the log's outcome.  log: stage, item_id, status, at, error_message, seq.

    A completed item stays completed when it starts or completes again; a failure always counts; a
    reset forgets what was before it.
    """
    resets = log.where(F.col("status") == "reset").groupBy("stage", F.col("item_id").alias("_i")).agg(F.max("seq").alias("_r"))
    whole = resets.where(F.col("_i").isNull()).select("stage", F.col("_r").alias("_rs"))
    own = resets.where(F.col("_i").isNotNull()).select("stage", F.col("_i").alias("item_id"), F.col("_r").alias("_ri"))
    live = log.where((F.col("status") != "reset") & F.col("item_id").isNotNull()).join(whole, "stage", "left").join(own, ["stage", "item_id"], "left")
    live = live.where(F.col("seq") > F.greatest(F.coalesce("_rs", F.lit(-1)), F.coalesce("_ri", F.lit(-1))))
    by = live.groupBy("stage", "item_id").agg(
        F.max(F.when(F.col("status") == "failed", F.col("seq"))).alias("_f"), F.max(F.when(F.col("status") == "completed", F.col("seq"))).alias("_c"), F.max_by("status", "seq").alias("_last"),
        F.max_by("at", F.when(F.col("status") == "completed", F.col("seq"))).alias("completed_at"), F.max_by("error_message", F.when(F.col("status") == "failed", F.col("seq"))).alias("_e"),
    )
    done = F.col("_c").isNotNull() & (F.col("_f").isNull() | (F.col("_c") > F.col("_f")))
    status = F.when(done, "completed").otherwise(F.col("_last"))
    return by.select("stage", "item_id", status.alias("status"), F.when(done, F.col("completed_at")).alias("completed_at"), F.when(status == "failed", F.col("_e")).alias("error_message"))


def pending(items: DataFrame, state: DataFrame, stage: str) -> DataFrame:
    """The items (item_id and others) of a stage that are not completed."""
    done = state.where((F.col("stage") == stage) & (F.col("status") == "completed")).select("item_id")
    return items.join(done, "item_id", "left_anti")


def without_lost(state: DataFrame, items: DataFrame, stage: str, value: str) -> DataFrame:
    """``state`` without those completed items of a stage whose ``value`` in ``items`` (item_id and others) is missing: they are pending again."""
    lost = items.where(F.col(value).isNull()).select(F.lit(stage).alias("stage"), "item_id", F.lit("completed").alias("status"))
    return state.join(lost, ["stage", "item_id", "status"], "left_anti").select(*state.columns)


def stage_status(state: DataFrame) -> DataFrame:
    """A row a stage with the number of its items in each status."""
    return state.groupBy("stage").agg(F.count("*").alias("n_items"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES])


def failures(state: DataFrame) -> DataFrame:
    """Items that are not completed, with messages cut at 100 characters."""
    e = F.col("error_message")
    return state.where(F.col("status") != "completed").select("stage", "item_id", "status", F.when(F.length(e) > 100, F.concat(F.substring(e, 1, 97), F.lit("..."))).otherwise(e).alias("error_message"))


def invalidated(stage: str) -> tuple[str, ...]:
    """Stages whose outputs go when ``stage`` runs again."""
    return DOWNSTREAM.get(stage, ())


def work(items: DataFrame, state: DataFrame, stage: str, force: bool = False, retry_failed: bool = False, targets: list[str] | None = None) -> DataFrame:
    """What a run of a stage has to do: everything if forced, the targets if named, else what is not completed."""
    if force and retry_failed:
        raise ValueError("force and retry_failed exclude each other")
    chosen = items if targets is None else items.where(F.col("item_id").isin(*targets))
    return chosen if force or targets is not None else pending(chosen, state, stage)
