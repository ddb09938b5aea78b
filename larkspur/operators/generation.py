"""Scans and publishing: identity match, change detection, tombstones, final states."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.storage import stored


def matched(listing: DataFrame, objects: DataFrame) -> DataFrame:
    """listing with object_id: by native id, else by (parent, name); null is new."""
    native = objects.select("native_id", F.col("object_id").alias("by_native"))
    place = objects.select("parent_id", "name", F.col("object_id").alias("by_place"))
    found = listing.join(native, "native_id", "left").join(place, ["parent_id", "name"], "left")
    found = found.withColumn("object_id", F.coalesce("by_native", "by_place")).drop("by_native", "by_place")
    if "kind" not in objects.columns or "kind" not in listing.columns:
        return found
    # an id that now names another kind of thing is a new object; the old one is retired
    kinds = objects.select("object_id", F.col("kind").alias("_kind"))
    found = found.join(kinds, "object_id", "left")
    other = F.col("_kind").isNotNull() & (F.col("_kind") != F.col("kind"))
    return found.withColumns({"retires": F.when(other, F.col("object_id")), "object_id": F.when(~F.coalesce(other, F.lit(False)), F.col("object_id"))}).drop("_kind")


def _compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """new with its generation and row_changed, as changed() has them."""
    shipped = [c for c in ("size", "allocated", "attributes", "created", "modified", "changed", "reparse_tag") if c in old.columns and c in new.columns]
    o = old.select(F.col("object_id").alias("_id"), F.col("generation").alias("_generation"), *(F.col(c).alias(f"_{c}") for c in shipped), *([F.col("content_state").alias("_state")] if "becomes" in new.columns else []))
    # an object may have several names
    j = new.drop("generation").join(o.dropDuplicates(["_id"]), F.col("object_id") == F.col("_id"), "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    content = differs("size") | differs("modified")
    if "becomes" in new.columns:
        content = content | F.coalesce(F.when(F.col("becomes") == "pending", F.col("_state") == "excluded").otherwise(F.col("_state") != F.col("becomes")), F.lit(False))
    content = (F.col("kind") == "file") & content
    generation = F.when(F.col("_generation").isNull(), 1).otherwise(F.col("_generation") + content.cast("int"))
    rows = j.withColumns({"generation": generation.cast("long"), "row_changed": reduce(or_, [content, *map(differs, shipped)])})
    return rows.select(*new.drop("generation").columns, "generation", "row_changed")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """object_id, generation, row_changed: a file's generation rises if its size, its time or the decision about it (`becomes`, a content state, if
    new has it) changed; other columns, but for the time of access, change just the row."""
    return _compared(old, new).select("object_id", "generation", "row_changed")


def published(previous: DataFrame, seen: DataFrame, listed: DataFrame) -> DataFrame:
    """previous with `live`: an entry dies if it was not seen though its parent was listed, and all below what died die too.
    Entries of directories that could not be listed stay. Ancestor closures make the cascade one join."""
    return _marked(previous, previous, _gone(previous.join(seen.select("entry_id"), "entry_id", "left_anti"), listed))


def _gone(unseen: DataFrame, listed: DataFrame) -> DataFrame:
    """gone_id, _dir of objects that died themselves."""
    gone = unseen.join(listed.select(F.col("dir_id").alias("parent_id")), "parent_id", "left_semi")
    return gone.select(F.col("object_id").alias("gone_id"), F.col("kind").isin("directory", "virtual_directory").alias("_dir")).distinct()


def _marked(rows: DataFrame, previous: DataFrame, gone: DataFrame) -> DataFrame:
    """rows, some of previous, with `live`, as published() has it."""
    # files die by their own id; below directories, which are fewer, what hangs on the parent is enough
    dirs = previous.where(F.col("kind").isin("directory", "virtual_directory"))
    above = dirs.select("object_id", F.explode(F.concat("ancestors", F.array("object_id"))).alias("gone_id"))
    dead_dirs = above.join(gone.where("_dir"), "gone_id", "left_semi").select("object_id").distinct()
    dead = dead_dirs.unionByName(gone.where("not _dir").select(F.col("gone_id").alias("object_id"))).select(F.col("object_id").alias("_own"), F.lit(True).alias("_dead"))
    below = dead_dirs.select(F.col("object_id").alias("_parent"), F.lit(True).alias("_orphan"))
    marked = rows.join(dead, F.col("object_id") == F.col("_own"), "left").join(below, F.col("parent_id") == F.col("_parent"), "left")
    return marked.withColumn("live", F.col("_dead").isNull() & F.col("_orphan").isNull()).drop("_dead", "_orphan", "_own", "_parent")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """(parent_id, name, object_id, action): refresh, insert, replace or remove."""
    o = old.select("parent_id", "name", F.col("object_id").alias("was"))
    n = new.select("parent_id", "name", F.col("object_id").alias("now"))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "remove").when(F.col("was") == F.col("now"), "refresh").otherwise("replace")
    return o.join(n, ["parent_id", "name"], "full_outer").select("parent_id", "name", F.coalesce("now", "was").alias("object_id"), action.alias("action"))


def final_state(errors: int, content_enabled: bool, unfinished: int, root_listed: bool = True, had_generation: bool = False) -> str:
    """The state in which a generation is published."""
    if not root_listed:
        return "offline" if had_generation else "failed"
    if errors:
        return "degraded"
    if not content_enabled:
        return "metadata_complete"
    return "content_pending" if unfinished else "complete"


def closure(edges: DataFrame) -> DataFrame:
    """object_id, ancestors (root first) of a forest (object_id, parent_id), level by level from the roots, with a guard against cycles. A recursive query in
    SQL has a limit of rows, which the session sets in which it is run. Levels are written to the shared folder, so each is made once."""
    edges = stored(edges.select("object_id", "parent_id"))
    below = edges.where(F.col("parent_id").isNotNull())
    level = stored(edges.where(F.col("parent_id").isNull()).select("object_id", F.array().cast("array<bigint>").alias("ancestors")))
    levels = [level]
    while level.head(1):
        above = level.select(F.col("object_id").alias("parent_id"), F.concat("ancestors", F.array("object_id")).alias("ancestors"))
        level = stored(below.join(above, "parent_id").where(~F.array_contains("ancestors", F.col("object_id"))).select("object_id", "ancestors"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def orphans(objects: DataFrame) -> DataFrame:
    """Live objects whose parent is missing or dead: a replica's topology is closed if there are none."""
    live = objects.where("deleted_at is null")
    return live.where("parent_id is not null").join(live.select(F.col("object_id").alias("parent_id")), "parent_id", "left_anti")


def cyclic(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (object_id, parent_id) that would put an object below itself: the new parent is the object or one of its descendants, by closure (object_id, ancestors) `edges`."""
    above = edges.select(F.col("object_id").alias("_p"), "ancestors")
    j = moves.join(above, F.col("parent_id") == F.col("_p"), "left")
    return j.where((F.col("parent_id") == F.col("object_id")) | F.array_contains(F.coalesce("ancestors", F.array().cast("array<bigint>")), F.col("object_id"))).select(*moves.columns)


def recovered(generations: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a crash: open generations are aborted, their sources degraded."""
    aborted = generations.withColumn("state", F.when(F.col("state") == "open", "aborted").otherwise(F.col("state")))
    hit = generations.where("state = 'open'").select("source_id").distinct().withColumn("_hit", F.lit(True))
    return aborted, sources.join(hit, "source_id", "left").withColumn("state", F.when(F.col("_hit"), "degraded").otherwise(F.col("state"))).drop("_hit")


def resolved_errors(errors: DataFrame, listed: DataFrame, generation: int) -> DataFrame:
    """Listing errors of older generations are resolved for directories that were listed now."""
    seen = listed.select(F.col("dir_id").alias("_dir"), F.lit(True).alias("_seen")).distinct()
    now = F.col("_seen") & (F.col("generation") < generation) & F.col("resolved_in").isNull()
    return errors.join(seen, F.col("dir_id") == F.col("_dir"), "left").withColumn("resolved_in", F.when(now, F.lit(generation)).otherwise(F.col("resolved_in"))).drop("_dir", "_seen")


def scan(previous: DataFrame, listing: DataFrame, listed: DataFrame, errors: int = 0, content_enabled: bool = True) -> tuple[DataFrame, str]:
    """One scan from listing to publishing. previous: a generation's live entries. listing: what was seen (entry and object ids as in matched()).
    listed: directories whose children are known. Entries that were not seen under listed directories die, with all below; others are taken over, new ones
    come in, changed files get their next generation. Gives the new entries and the state in which they are published."""
    base = previous if "generation" in previous.columns else previous.withColumn("generation", F.lit(1).cast("long"))
    fresh = _compared(base.select("object_id", "generation", "size", "allocated", "attributes", "created", "modified"), listing)
    # what was seen stays as it was seen, so only the rest is asked whether it lives. It is few rows as a rule, whose keys later steps take from the shared folder
    left = stored(base.select("entry_id", "object_id", "parent_id", "kind").join(listing.select("entry_id"), "entry_id", "left_anti"))
    live = stored(_marked(left, base, stored(_gone(left, listed))).where("live").select("entry_id"))
    unseen = base.join(live, "entry_id", "left_semi")
    entries = unseen.unionByName(fresh.select(unseen.columns))
    # all that was seen is among the entries
    some = lambda test: test(listing) or test(unseen)
    root_listed = some(lambda rows: bool(listed.join(rows.where("parent_id is null").select(F.col("object_id").alias("dir_id")), "dir_id", "left_semi").head(1)))
    if not root_listed:
        return entries, final_state(errors, content_enabled, 0, False, bool(previous.head(1)))
    unfinished = content_enabled and not errors and some(lambda rows: bool(rows.where(F.col("content_state").isin("pending", "stale", "failed")).select("entry_id").head(1)))
    return entries, final_state(errors, content_enabled, int(unfinished))
