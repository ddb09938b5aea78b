"""Inclusion policy, operator rules, coverage and completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.classify import LISTED_ARCHIVES, kind_of

METADATA_COMPLETE = ("metadata_complete", "content_pending", "complete")
MOST_RULES, MOST_PREVIEW = 100, 50
#: Attribute bits.
REPARSE, OFFLINE, RECALL = 0x400, 0x1000, 0x400000
#: Names of directories, of their parents (none: any) and whether they must be at the root -> reason of all files below.
DIRECTORY_RULES = [
    ("$recycle.bin recycler recycled", "", True, "recycle_bin"),
    ("system volume information", "", True, "system_volume_information"),
    ("node_modules bower_components jspm_packages", "", False, "dependency_cache"),
    ("site-packages .venv venv .tox", "", False, "dependency_cache"),
    ("__pycache__ .cache .pytest_cache .mypy_cache .ruff_cache", "", False, "known_cache"),
    ("packages", ".nuget", False, "dependency_cache"),
    ("registry git", ".cargo", False, "dependency_cache"),
    ("objects lfs", ".git", False, "known_cache"),
    ("temp tmp", "local", False, "known_cache"),
    ("inetcache webcache gpucache cache2", "", False, "known_cache"),
    ("code cache", "", False, "known_cache"),
    ("service worker", "", False, "known_cache"),
    ("winsxs servicing", "windows", False, "package_artifact"),
    ("installer", "windows", False, "package_artifact"),
]
#: Names of two words in DIRECTORY_RULES stand alone.
_WHOLE = ("system volume information", "code cache", "service worker")
SWAP_FILES = ("pagefile.sys", "hiberfil.sys", "swapfile.sys")


def directory_rule(name: Column, parent: Column, at_root: Column) -> Column:
    """The reason that a directory of this name (folded) gives the files below it, or null."""
    out = F.when(F.lit(False), "")
    for names, above, root, reason in DIRECTORY_RULES:
        test = name.isin([names] if names in _WHOLE else names.split())
        if above:
            test = test & (parent == above)
        out = out.when(test & at_root if root else test, reason)
    return out


def inherited(folders: Column) -> Column:
    """The reason of the outermost directory of a path that has one; folders: names below the root, folded."""
    tested = F.transform(folders, lambda name, i: directory_rule(name, F.coalesce(F.get(folders, i - 1), F.lit("")), i == 0))
    return F.get(F.filter(tested, lambda r: r.isNotNull()), F.lit(0))


def _within(path: Column, root: str, case: bool) -> Column:
    root = root.rstrip("/") if case else root.rstrip("/").lower()
    column = path if case else F.lower(path)
    return (column == root) | F.startswith(column, F.lit(root + "/"))


def decision(rules: Sequence[tuple[str, str, bool]] = (), protected: Sequence[str] = (), case: bool = False, root: str = "") -> Column:
    """reason of a file; '' is a candidate and 'unsupported' no candidate without a reason. In this order: own storage (protected
    paths), reparse points, swap files at the root, offline files, operator rules (the last match wins), directories above, kind.
    A rule is (prefix or regex, value, include); paths are compared folded unless the volume minds case. root is the source's path."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    path, bits = F.col("path"), F.col("attributes")
    relative = F.substring(path, len(root.rstrip("/")) + 2, 1 << 30) if root else F.ltrim(path, F.lit("/"))
    parts = F.split(F.lower(relative), "/")
    kind = kind_of(F.col("extension"))
    by_kind = (
        F.when(kind == "disk_image", "vm_disk_image").when(kind == "media", "media_file").when(kind.isin("binary", "database"), "binary_data")
        .when((kind == "archive") & ~F.col("extension").isin(LISTED_ARCHIVES.split()) | (kind == "document"), "unsupported").otherwise("")
    )
    rest = F.coalesce(inherited(F.slice(parts, 1, F.size(parts) - 1)), by_kind)
    for form, value, include in rules:  # a later rule is asked first
        test = _within(path, value, case) if form == "prefix" else path.rlike(("" if case else "(?iu)") + value)
        rest = F.when(test, "" if include else "user_exclude").otherwise(rest)
    out = F.when(F.lit(False), "")
    for place in protected:
        out = out.when(_within(path, place, case), "self_store")
    out = out.when(bits.bitwiseAND(F.lit(REPARSE)) != 0, "symlink").when((F.size(parts) == 1) & F.lower("name").isin(*SWAP_FILES), "swap_or_hibernation")
    return out.when(bits.bitwiseAND(F.lit(OFFLINE | RECALL)) != 0, "binary_data").otherwise(rest)


def decided(entries: DataFrame, rules: Sequence[tuple[str, str, bool]] = (), **options) -> DataFrame:
    """Decisions about files: reason, and whether content is wanted."""
    reason = decision(rules, **options)
    files = entries.where(F.col("kind") == "file").select("entry_id", "object_id", "size", F.lit("content").alias("stage"), reason.alias("reason"))
    return files.withColumn("included", F.col("reason") == "")


def initial_state(reason: Column) -> Column:
    """The content state in which a decision puts a file."""
    return F.when(reason == "", "pending").when(reason == "unsupported", "unsupported").otherwise("excluded")


def rules_preview(entries: DataFrame, rules: Sequence[tuple[str, str, bool]], most: int = MOST_PREVIEW, **options) -> DataFrame:
    """path, was, becomes of files whose state the rules would change, in order of path, at most so many."""
    files = entries.where(F.col("kind") == "file")
    rows = files.select("path", F.col("content_state").alias("was"), initial_state(decision(rules, **options)).alias("becomes"))
    # extracted and unsupported files stay unless the rules exclude them
    moved = F.when(F.col("becomes") == "pending", F.col("was") == "excluded").otherwise(F.col("was") != F.col("becomes"))
    return rows.where(moved).orderBy("path").limit(most)


def applied(entries: DataFrame, rules: Sequence[tuple[str, str, bool]], **options) -> DataFrame:
    """entries after a change of rules: files whose state changes get a new generation; `purged` marks those whose chunks go."""
    # the decision is a column of its own, so that what uses it doesn't make it again
    rows = entries.withColumn("_reason", decision(rules, **options))
    rows = rows.withColumn("_becomes", initial_state(F.col("_reason")))
    moved = F.when(F.col("_becomes") == "pending", F.col("content_state") == "excluded").otherwise(F.col("content_state") != F.col("_becomes"))
    rows = rows.withColumn("_moved", (F.col("kind") == "file") & moved)
    rows = rows.withColumns({
        "purged": F.col("_moved") & (F.col("_becomes") != "pending"),
        "generation": F.coalesce("generation", F.lit(1)) + F.col("_moved").cast("int") if "generation" in entries.columns else F.lit(1) + F.col("_moved").cast("int"),
        "content_state": F.when(F.col("_moved"), F.col("_becomes")).otherwise(F.col("content_state")),
    })
    return rows.drop("_moved", "_becomes", "_reason")


def completeness(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """source_id, metadata_complete, content_complete from the source's state and its counts by content state."""
    left = counts.where(F.col("content_state").isin("pending", "stale", "failed", "indexing")).groupBy("source_id").agg(F.sum("objects").alias("unfinished"))
    j = sources.join(left, "source_id", "left")
    meta = F.col("state").isin(*METADATA_COMPLETE)
    return j.select("source_id", meta.alias("metadata_complete"), (meta & (F.coalesce("unfinished", F.lit(0)) == 0)).alias("content_complete"), F.coalesce("unfinished", F.lit(0)).alias("unfinished"))


#: What keeps an answer from being full, and how grave it is.
SEVERITY = {
    "offline": "warning", "stale": "warning", "degraded_feed": "warning", "enumerating": "warning", "reconciling": "info", "not_scanned": "error", "not_indexed": "error", "index_lag": "info",
    "content_pending": "warning", "content_failed": "warning", "listing_errors": "warning", "policy_exclusion": "info", "truncated": "warning", "timeout": "warning", "generation_reset": "warning", "content_not_replicated": "warning",
}


def coverage_reasons(sources: DataFrame, now: int, stale_after: int, content: bool = True, truncated: bool = False, timeout: bool = False) -> DataFrame:
    """source_id, reasons, severity, full: what keeps an answer from being full. Columns: state, published_generation, index_generation, last_scan,
    errors, pending, failed, excluded, lag, epoch_changed, replica, live_feed; `content` says whether the query consults content, the
    last two what happened to the answer as a whole."""
    have = set(sources.columns)
    column = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    published, state = F.col("published_generation"), F.col("state")
    behind = F.coalesce(F.col("index_generation"), F.lit(-1)) < F.coalesce(published, F.lit(0))
    rules = {
        "offline": state == "offline",
        "stale": ~column("live_feed", False) & ((F.lit(now) - F.coalesce("last_scan", F.lit(0))) >= 2 * stale_after),
        "degraded_feed": state == "degraded",
        "enumerating": (state == "scanning") & published.isNull(),
        "reconciling": (state == "scanning") & published.isNotNull(),
        "not_scanned": published.isNull() & (state != "scanning"),
        "not_indexed": published.isNotNull() & behind,
        "index_lag": ~behind & (column("lag", 0) > 0),
        "content_pending": F.lit(content) & (F.col("pending") > 0),
        "content_failed": F.lit(content) & (F.col("failed") > 0),
        "listing_errors": F.col("errors") > 0,
        "policy_exclusion": F.lit(content) & (column("excluded", 0) > 0),
        "truncated": F.lit(truncated),
        "timeout": F.lit(timeout),
        "generation_reset": column("epoch_changed", False),
        "content_not_replicated": F.lit(content) & column("replica", False),
    }
    reasons = F.filter(F.array(*(F.when(test, name) for name, test in rules.items())), lambda r: r.isNotNull())
    grave = lambda level: F.exists("reasons", lambda r: r.isin([k for k, v in SEVERITY.items() if v == level]))
    rows = sources.select("source_id", reasons.alias("reasons"))
    return rows.select("source_id", "reasons", F.when(grave("error"), "error").when(grave("warning"), "warning").when(grave("info"), "info").alias("severity"), (F.size("reasons") == 0).alias("full"))


def reconcile(sources: DataFrame, now: int) -> DataFrame:
    """source_id, action: rescan once an interval has passed without a live feed, stale after two."""
    age = F.lit(now) - F.coalesce("last_scan", F.lit(0))
    due = age >= F.col("interval")
    return sources.select("source_id", F.when(F.col("live_feed"), "none").when(age >= 2 * F.col("interval"), "stale").when(due, "rescan").otherwise("none").alias("action"))
