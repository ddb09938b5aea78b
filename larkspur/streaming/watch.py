"""Feeds of a volume or a folder as they come: outcomes of reading, path events, the overlap of a scan with its feed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directories that a batch of path events may expand to; beyond, a scan is cheaper.
MOST_EXPANDED = 50_000


@dataclass(frozen=True)
class Journal:
    """A journal as it is now: its identity and the positions that can still be read."""

    identity: int
    first: int
    next: int


def read_journal(records: DataFrame, have: Journal, identity: int, position: int, limit: int | None = None) -> tuple[str, DataFrame]:
    """Outcome of reading on from a position, and the records (usn, ...): `records`, `empty`, `identity_changed` (another journal), `overflow` (what
    follows was overwritten). The last two ask for a scan."""
    none = records.where(F.lit(False))
    if have.identity != identity:
        return "identity_changed", none
    if position < have.first:
        return "overflow", none
    if position >= have.next:
        return "empty", none
    found = records.where((F.col("usn") >= position) & (F.col("usn") < have.next)).orderBy("usn")
    return "records", found.limit(limit) if limit else found


def path_events(events: DataFrame, entries: DataFrame, listing: DataFrame) -> tuple[str, DataFrame | None]:
    """Changes that path events stand for: (op, path) by what is there now. events: path, must_scan_below, dropped. Lost events ask for a scan, and so
    does a batch that reaches more than MOST_EXPANDED entries; else each path, and all below it where the event says so, is compared with the listing."""
    if events.where("dropped").head(1):
        return "rescan", None
    spots = events.groupBy("path").agg(F.bool_or("must_scan_below").alias("below"))
    deep = spots.where("below").select(F.col("path").alias("top"))

    def touched(rows: DataFrame) -> DataFrame:
        """Rows at an event's path or below one, by their own prefixes, so that the join is an equality."""
        own = rows.join(spots.select("path"), "path", "left_semi")
        parts = F.split("path", "/")
        tops = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        below = rows.withColumn("top", F.explode(tops)).join(deep, "top", "left_semi").select(rows.columns)
        return own.unionByName(below).distinct()

    was, now = (touched(t.select("path", *extra)) for t, extra in ((entries, ["modified"]), (listing, ["modified"])))
    now = now.withColumnRenamed("modified", "_now")
    both = was.join(now, "path", "full_outer").limit(MOST_EXPANDED + 1)
    if both.count() > MOST_EXPANDED:
        return "rescan", None
    op = F.when(F.col("_now").isNull(), "delete").when(F.col("modified").isNull(), "link").when(F.col("modified") != F.col("_now"), "update")
    out = both.select(op.alias("op"), "path").where("op is not null")
    return "changes", out.orderBy(F.size(F.split("path", "/")), "path")


@dataclass(frozen=True)
class Overlap:
    """A scan that runs while its feed goes on: the position before it, then the listing, then what the feed saw meanwhile, then publishing."""

    checkpoint: int | None
    step: str = "started"  # started, enumerated, replayed, published, aborted
    degraded: bool = False

    def enumerated(self, ok: bool) -> Overlap:
        return replace(self, step="enumerated" if ok and self.step == "started" else "aborted")

    def replayed(self, outcome: str, position: int | None) -> Overlap:
        """A feed that wrapped meanwhile leaves no checkpoint: the generation is published as degraded."""
        if self.step != "enumerated":
            return replace(self, step="aborted")
        lost = outcome in ("overflow", "identity_changed")
        return replace(self, step="replayed", checkpoint=None if lost else position, degraded=lost)

    def published(self) -> Overlap:
        return replace(self, step="published" if self.step == "replayed" else "aborted")
