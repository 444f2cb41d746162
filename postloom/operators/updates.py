"""Updates of job tables, as DataFrame to DataFrame: the result replaces the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sweep_orphans(jobs: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Jobs that ran when the service stopped fail, with their running sources and an error row; queued ones can go on.

    Returns jobs, sources, the new error rows and the ids that can go on. Paused jobs stay as they are.
    """
    running = jobs.where("status = 'running'").select(F.col("id").alias("job_id"))
    new_jobs = jobs.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))
    marked = sources.join(running.withColumn("__gone", F.lit(True)), "job_id", "left")
    stopped = F.coalesce("__gone", F.lit(False)) & (F.col("status") == "running")
    new_sources = marked.withColumn("status", F.when(stopped, "failed").otherwise(F.col("status"))).drop("__gone").select(*sources.columns)
    errors = running.select("job_id", F.lit("suspended_by_restart").alias("code"), F.lit("").alias("source_url"))
    return new_jobs, new_sources, errors, jobs.where("status = 'queued'").select("id")


#: States that an action may start from, and what it makes of them.
TRANSITIONS = {"pause": (("queued", "running"), "paused"), "resume": (("paused",), "queued")}


def transition(jobs: DataFrame, actions: DataFrame) -> DataFrame:
    """R2: jobs with an action (id, action): the new status, or the error invalid_state."""
    out = jobs.join(actions, "id")
    new = F.lit(None).cast("string")
    for name, (origin, target) in TRANSITIONS.items():
        new = F.when((F.col("action") == name) & F.col("status").isin(*origin), target).otherwise(new)
    return out.select("id", "action", F.coalesce(new, F.col("status")).alias("status"), F.when(new.isNull(), "invalid_state").alias("error"))


def fail_sources(sources: DataFrame, states: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and checkpoints with their failures (source_id, job_id, code, message) entered."""
    hit = failures.select("source_id", "job_id", "code", "message")
    s = sources.join(hit, ["source_id", "job_id"], "left")
    bad = F.col("code").isNotNull()
    new_sources = s.select(
        "source_id", "job_id", F.when(bad, "failed").otherwise(F.col("status")).alias("status"), F.coalesce("code", "error_code").alias("error_code"),
        (F.col("errors_count") + bad.cast("int")).alias("errors_count"),
    )
    c = states.join(hit, ["source_id", "job_id"], "left")
    new_states = c.select("id", "source_id", "job_id", F.when(bad, "failed").otherwise(F.col("status")).alias("status"), (F.col("consecutive_errors") + bad.cast("int")).alias("consecutive_errors"))
    return new_sources, new_states


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with the fields that new rows supply; new keys are added, null fields overwrite nothing."""
    fields = [c for c in old.columns if c not in keys]
    other = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields if c in new.columns])
    value = lambda c: F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c)
    return old.join(other, keys, "full").select(*keys, *[value(c) for c in fields])


def reset_for_resume(states: DataFrame) -> DataFrame:
    """Checkpoints ready for another crawl: created, without errors."""
    return states.withColumns({"status": F.lit("created"), "consecutive_errors": F.lit(0).cast("long"), "error_code": F.lit(None).cast("string")})


def backfill_plans(users: DataFrame) -> DataFrame:
    """Plans free and none become basic."""
    old = F.coalesce(F.col("plan"), F.lit("free")) == "free"
    return users.withColumn("plan", F.when(old, "basic").otherwise(F.col("plan")))
