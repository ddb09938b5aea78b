"""Counts, queues, retention and other bookkeeping over catalog tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.classify import LISTED_ARCHIVES, is_text_candidate, kind_of

BACKOFF_S, MOST_ATTEMPTS = 10, 6
RETRYABLE = ("transient",)


def state_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source_id", "content_state").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def exclusion_summary(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.col("included")).groupBy("stage", "reason").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def link_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("object_id").agg(F.count("*").alias("links"))


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("stage", "state").agg(F.count("*").alias("jobs"), F.min(F.when(F.col("state") == "queued", F.col("scheduled_at"))).alias("oldest_queued"))


def claim(jobs: DataFrame, limit: int, now: int) -> DataFrame:
    """Queued jobs that are due, in the order in which they are claimed."""
    return jobs.where((F.col("state") == "queued") & (F.col("scheduled_at") <= now)).orderBy("priority", "scheduled_at", "job_id").limit(limit)


def superseded(jobs: DataFrame) -> DataFrame:
    """Jobs of a generation older than the newest of their object and stage."""
    newest = jobs.groupBy("object_id", "stage").agg(F.max("generation").alias("newest"))
    return jobs.join(newest, ["object_id", "stage"]).where("generation < newest").drop("newest")


def retry_plan(jobs: DataFrame) -> DataFrame:
    """job_id, outcome (accepted, skipped, rejected), reason, delay_s of failed jobs."""
    failed = F.col("state") == "failed"
    transient = F.col("failure").isin(*RETRYABLE)
    outcome = F.when(~failed, "skipped").when(~transient, "rejected").when(F.col("attempts") >= MOST_ATTEMPTS, "rejected").otherwise("accepted")
    reason = F.when(~failed, "not_failed").when(~transient, "permanent").when(F.col("attempts") >= MOST_ATTEMPTS, "attempts").otherwise("")
    delay = F.when(outcome == "accepted", F.lit(BACKOFF_S) * F.pow(F.lit(2.0), F.col("attempts"))).otherwise(0)
    return jobs.select("job_id", outcome.alias("outcome"), reason.alias("reason"), delay.cast("long").alias("delay_s"))


def newest_rows(rows: DataFrame, key: str, keep: int) -> DataFrame:
    """The newest `keep` rows: those at or above the keep-th highest key, found by a top-k."""
    edge = rows.select(key).orderBy(F.desc(key)).limit(keep).agg(F.min(key).alias("_edge"), F.lit(0).alias("_k"))
    return rows.withColumn("_k", F.lit(0)).join(F.broadcast(edge), "_k").where(F.col(key) >= F.col("_edge")).drop("_k", "_edge")


def interaction_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("sessions"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def percentiles(rows: DataFrame, group: str, value: str, points: tuple = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles sorted[round(p / 100 * (n - 1))] of each group, by ranks in buckets (no group is one window, no list is made)."""
    from larkspur.streaming.ledger import ranked

    known = rows.select(group, value).where(F.col(value).isNotNull())
    total = known.groupBy(group).agg(F.count("*").alias("_n")).withColumnRenamed(group, "_group")
    at = ranked(known, group, value).join(total, F.col(group).eqNullSafe(F.col("_group")))
    wanted = lambda p: F.floor(F.lit(p / 100) * (F.col("_n") - 1) + 0.5) + 1
    cols = [F.max(F.when(F.col("rank") == wanted(p), F.col(value))).alias(f"p{p}") for p in points]
    return at.groupBy(group).agg(*cols, F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"))


def profile_kinds(entries: DataFrame) -> DataFrame:
    files = entries.where(F.col("kind") == "file").withColumn("file_kind", kind_of(F.col("extension")))
    return files.groupBy("file_kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(is_text_candidate(F.col("extension"))).alias("text_candidates"))


def top_by(rows: DataFrame, key: str, tie: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(key), tie).limit(n)


def size_histogram(entries: DataFrame) -> DataFrame:
    """power (floor of log2 of the size, -1 for empty files), files, bytes."""
    power = F.when(F.col("size") <= 0, -1).otherwise(F.length(F.bin("size")) - 1)
    return entries.where(F.col("kind") == "file").groupBy(power.cast("int").alias("power")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def bakeoff(runs: DataFrame) -> DataFrame:
    """Sums of transfer runs by strategy."""
    return runs.groupBy("strategy").agg(F.sum("wire_bytes").alias("wire_bytes"), F.sum("source_bytes").alias("source_bytes"), F.round(F.sum("wire_bytes") / F.sum("source_bytes"), 6).alias("ratio"), F.sum("frames").alias("frames"))


#: Sizes up to which text is small and normal, and priorities of the three sizes and of archives.
SMALL_TEXT, NORMAL_TEXT = 1 << 20, 64 << 20
PRIORITIES = {"archive": 2, "small": 3, "normal": 4, "large": 5}


def enqueued(objects: DataFrame, entries: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """New content jobs for live files that are pending or stale and have none of their generation: object_id, object_generation, priority,
    idempotency_key, estimated_cost, small ones first. The extension is that of the object's first live entry."""
    key = F.concat_ws(":", F.lit("content_text"), F.col("object_id").cast("string"), F.col("generation").cast("string"))
    first = entries.groupBy("object_id").agg(F.min_by("extension", "entry_id").alias("extension"))
    wanted = objects.where((F.col("kind") == "file") & F.col("content_state").isin("pending", "stale")).withColumn("idempotency_key", key)
    wanted = wanted.drop("extension").join(jobs.select("idempotency_key"), "idempotency_key", "left_anti").join(first, "object_id", "left")
    size = F.when(F.col("size") < SMALL_TEXT, PRIORITIES["small"]).when(F.col("size") < NORMAL_TEXT, PRIORITIES["normal"]).otherwise(PRIORITIES["large"])
    priority = F.when(F.lower("extension").isin(LISTED_ARCHIVES.split()), PRIORITIES["archive"]).otherwise(size)
    out = wanted.select("object_id", F.col("generation").alias("object_generation"), priority.alias("priority"), "idempotency_key", F.col("size").alias("estimated_cost"))
    return out.orderBy("estimated_cost", "object_id").limit(limit) if limit else out


def finished(jobs: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """jobs after results (job_id, ok, failure): done; back in the queue with a longer delay for transient failures below the most attempts; else failed."""
    j = jobs.drop("failure").join(results.select("job_id", "ok", "failure"), "job_id", "left")
    ran = F.col("ok").isNotNull() & (F.col("state") == "running")
    again = ~F.col("ok") & F.col("failure").isin(*RETRYABLE) & (F.col("attempts") + 1 < MOST_ATTEMPTS)
    state = F.when(~ran, F.col("state")).when(F.col("ok"), "done").when(again, "queued").otherwise("failed")
    delay = (F.lit(BACKOFF_S) * F.pow(F.lit(2.0), F.col("attempts"))).cast("long") * 10**9
    return j.withColumns({
        "state": state, "scheduled_at": F.when(ran & again, F.lit(now) + delay).otherwise(F.col("scheduled_at")), "attempts": F.col("attempts") + F.coalesce((ran & ~F.col("ok")).cast("int"), F.lit(0)),
    }).drop("ok")


def jobs_by_source(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("source_id", "state").agg(F.count("*").alias("jobs"), F.coalesce(F.sum("estimated_cost"), F.lit(0)).alias("bytes"))


def failed_work(jobs: DataFrame, objects: DataFrame, stage: str = "content_text") -> DataFrame:
    """source_id, items, bytes: failed jobs of a stage, and failed objects that have no job of it at work."""
    stuck = jobs.where((F.col("stage") == stage) & (F.col("state") == "failed")).select("source_id", F.col("estimated_cost").alias("cost"))
    active = jobs.where((F.col("stage") == stage) & F.col("state").isin("queued", "running", "failed")).select("object_id")
    lost = objects.where("content_state = 'failed'").join(active, "object_id", "left_anti").select("source_id", F.col("size").alias("cost"))
    return stuck.unionByName(lost).groupBy("source_id").agg(F.count("*").alias("items"), F.coalesce(F.sum("cost"), F.lit(0)).alias("bytes"))


def job_details(jobs: DataFrame, objects: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs with what their object and source are now; of either there may be none."""
    o = objects.select("object_id", F.col("generation").alias("current_generation"), F.col("deleted_at").isNotNull().alias("deleted"))
    s = sources.select("source_id", F.col("state").alias("source_state"), "content_enabled")
    return jobs.join(o, "object_id", "left").join(F.broadcast(s), "source_id", "left")  # one row for each source


def retry_preview(details: DataFrame) -> DataFrame:
    """job_id, outcome, reason of candidates (job_details()): not worth running any more are skipped, those at work are rejected."""
    reason = (
        F.when(F.col("current_generation").isNull() | F.coalesce("deleted", F.lit(True)), "deleted").when(F.col("source_state") == "retired", "retired")
        .when(F.col("current_generation") > F.col("object_generation"), "superseded").when(~F.coalesce("content_enabled", F.lit(False)), "content_disabled")
        .when(F.col("state") == "running", "running").when(F.col("state") == "queued", "already_queued").when(F.col("state") == "done", "done").otherwise("")
    )
    outcome = F.when(reason == "", "accepted").when(reason.isin("running", "already_queued", "done"), "rejected").otherwise("skipped")
    return details.select("job_id", outcome.alias("outcome"), reason.alias("reason"))


def confirmation(preview: DataFrame) -> str:
    """A digest of the accepted jobs, which doesn't depend on their order: an action goes on only if it is still the same."""
    row = preview.where("outcome = 'accepted'").agg(F.count("*").alias("n"), F.sum(F.xxhash64("job_id").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(7), F.col("job_id"))).alias("x")).first()
    return hashlib.sha256(f"{row['n']}|{row['h']}|{row['x']}".encode()).hexdigest()[:32]


def refreshed(sources: DataFrame, objects: DataFrame) -> DataFrame:
    """Sources with their state moved among the steady ones by whether content is unfinished; others stay as they are."""
    open_ = objects.where((F.col("kind") == "file") & F.col("content_state").isin("pending", "stale", "failed")).select("source_id").distinct().withColumn("_open", F.lit(True))
    steady = F.col("published_generation").isNotNull() & F.col("state").isin("metadata_complete", "content_pending", "complete")
    to = F.when(~F.col("content_enabled"), "metadata_complete").when(F.coalesce("_open", F.lit(False)), "content_pending").otherwise("complete")
    return sources.join(open_, "source_id", "left").withColumn("state", F.when(steady, to).otherwise(F.col("state"))).drop("_open")


def flipped(flips: DataFrame) -> DataFrame:
    """Deltas of directories for files (source_id, ancestors, was, becomes) whose content state changes: counters move, bytes don't."""
    from larkspur.operators.rollup import BUCKETS

    moved = lambda states: F.col("becomes").isin(*states).cast("int") - F.col("was").isin(*states).cast("int")
    below = flips.select("source_id", F.explode("ancestors").alias("dir_id"), *(moved(states).alias(f"{name}_count") for name, states in BUCKETS.items()))
    return below.groupBy("source_id", "dir_id").agg(*(F.sum(f"{name}_count").alias(f"{name}_count") for name in BUCKETS))


def content_stats(records: DataFrame) -> DataFrame:
    return records.groupBy("state").agg(F.count("*").alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def kept_interactions(events: DataFrame, now: int, days: int = 90, most: int = 1_000_000) -> DataFrame:
    """Events not older than so many days, of these the newest."""
    return newest_rows(events.where(F.col("at") >= now - days * 86_400 * 10**9), "event_id", most)


def activity(entries: DataFrame, jobs: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for each source: objects, bytes, queued and failed jobs, open errors."""
    a = entries.groupBy("source_id").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))
    b = jobs.groupBy("source_id").agg(F.count_if(F.col("state") == "queued").alias("queued"), F.count_if(F.col("state") == "failed").alias("failed"))
    c = errors.where("resolved_in is null").groupBy("source_id").agg(F.count("*").alias("open_errors"))
    return a.join(b, "source_id", "full").join(c, "source_id", "full").fillna(0)


def recent(rows: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The newest rows (errors, generations, jobs)."""
    return rows.orderBy(F.desc(key)).limit(limit)
