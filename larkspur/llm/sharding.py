"""Balanced label propagation: linked documents share shards, shards stay even. Native Spark only.

Documents with the same link key (here: equal texts) form a hyperedge. Labels start from a hash of
the document. Each round, the documents of a group want to be where most of their neighbours are;
a shard admits no more than its quota has room for, so sizes never leave the law's bounds. A group
larger than a shard has several homes, and its lanes (slices of at most about LANE documents and a quarter of a shard) go to them in
turn. Documents of a lane with one label are alike, so rounds run on counts: cells (group, lane,
shard, n), a table no larger than the linked documents. Rounds end when one moves no row. At last, documents take their cells' labels,
what exceeds a shard's quota and documents without links fill the shards' remaining places in hash
order.

Law `rows`: counts of any two shards differ by one at most.

Scale: texts are read once and leave as narrow rows; groups are counted through 64 salts and lanes
of hashes, so a hot group is in no step one key; ranks inside shards, and what is admitted before a row,
come from counts of hash buckets and a window in each bucket. Tables of one row for each shard are broadcast.

Defined results: a null text has size 16, CRC 0 and no links; empty texts are equal texts; repeated rows are
separate documents with equal texts; a null doc_id is hashed like any value; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import durable

SHARDS = 40
#: A bound; rounds end when one moves no row.
ROUNDS = 24
LANE = 200
SALTS = 64
#: Documents of a bucket in which ranks are counted.
BUCKET = 400
#: Room for each lot, and lanes of a group for each part of a lot: they set how finely admission is dealt out, not who is admitted.
LOT = 5000
LOT_LANES = 1000
OVERHEAD = 16


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, link (null: no link), row (tells rows apart)."""
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("link"),
    )
    return rows.withColumn("row", F.xxhash64("doc_id", "link"))


def _ranked(rows: DataFrame, keys: list[str], buckets: int, order: list[Column], name: str) -> DataFrame:
    """Rank from 0 among the rows of the same keys (a few), by bucket counts and a window in each bucket."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("row", F.lit(11)), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    # offsets: sums of sums, so that no window holds more than about the root of the buckets
    step = max(1, int(buckets**0.5))
    counts = counts.withColumn("_g", (F.col("_b") / step).cast("int"))
    outer = counts.groupBy(*keys, "_g").agg(F.sum("_n").alias("_gn"))
    outer = outer.withColumn("_go", F.sum("_gn").over(Window.partitionBy(*keys).orderBy("_g")) - F.col("_gn")).drop("_gn")
    counts = counts.withColumn("_o", F.sum("_n").over(Window.partitionBy(*keys, "_g").orderBy("_b")) - F.col("_n")).drop("_n")
    offsets = counts.join(outer, [*keys, "_g"]).select(*keys, "_b", (F.col("_o") + F.col("_go")).alias("_off"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    return rows.join(offsets, [*keys, "_b"]).withColumn(name, (F.col("_r") + F.col("_off")).cast("long")).drop("_b", "_r", "_off")


def _cells(rows: DataFrame, shards: int, quota: int) -> tuple[DataFrame, DataFrame]:
    """Linked rows with (link, lane), and the first cells (link, lane, shard, n) with the group's size."""
    salted = rows.where("link is not null").withColumn("salt", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("link", "salt").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("link").agg(F.sum("n").alias("group_n")).where("group_n > 1")
    parts = parts.join(sizes, "link").select("link", "salt", "group_n")
    linked = salted.join(parts, ["link", "salt"]).drop("salt")
    linked = linked.withColumn("lanes", F.ceil(F.col("group_n") / float(min(LANE, max(1, quota // 4)))).cast("int"))
    linked = durable(linked.withColumn("lane", F.pmod(F.xxhash64("row", F.lit(6)), F.col("lanes")).cast("int")))
    start = linked.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(shards)).cast("int"))
    cells = start.groupBy("link", "lane", "shard").agg(F.count("*").alias("n"), F.first("group_n").alias("group_n"), F.first("lanes").alias("lanes"))
    return linked, cells


def _round(cells: DataFrame, quota: int, shards: int, number: int) -> DataFrame:
    """One round of propagation under quotas."""
    spark = cells.sparkSession
    load = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(cells.groupBy("shard").agg(F.sum("n").alias("load")), "shard", "left")
    load = load.select("shard", F.greatest(F.lit(quota) - F.coalesce("load", F.lit(0)), F.lit(0)).alias("room"))
    # neighbours of a group by shard; shards with room for the rest of it come first
    near = cells.groupBy("link", "shard").agg(F.sum("n").alias("here"), F.first("group_n").alias("group_n"))
    near = near.join(F.broadcast(load), "shard")
    share = F.least(F.col("group_n"), F.lit(quota))
    order = Window.partitionBy("link").orderBy(F.desc(F.col("here") + F.col("room") >= share), F.desc("here"), F.xxhash64("link", "shard"))
    homes = near.withColumn("home", F.row_number().over(order) - 1).where(F.col("home") < F.ceil(F.col("group_n") / F.lit(float(quota))))
    homes = homes.select("link", F.col("home").cast("int").alias("home"), F.col("shard").alias("to"))
    # the round's number comes as a value: as a literal it would make new code of every later stage in each round, which the driver compiles and holds
    n_homes = homes.groupBy("link").agg(F.count("*").alias("homes"), F.max(F.lit(number)).alias("turn"))
    # who is in a home stays; others try the homes in turn, each round another one
    at_home = homes.select("link", F.col("to").alias("shard"), F.lit(True).alias("at_home"))
    wish = cells.join(at_home, ["link", "shard"], "left")
    movers = wish.where("at_home is null").join(n_homes, "link").withColumn("home", F.pmod(F.col("lane") + F.col("turn"), F.col("homes")).cast("int")).join(homes, ["link", "home"])
    # admission against the whole room, large gains first; what stands before a row comes from sums of its gain, its lot and a window inside the lot
    lots = F.lit(max(1, quota // LOT))
    movers = movers.withColumn("lot", F.pmod(F.xxhash64("link", "turn"), lots).cast("int")).withColumn("part", (F.col("lane") / LOT_LANES).cast("int"))
    sums = movers.groupBy("to", "n", "lot", "part").agg(F.sum("n").alias("all"))
    gains = sums.groupBy("to", "n").agg(F.sum("all").alias("of_n"))
    gains = gains.withColumn("larger", F.sum("of_n").over(Window.partitionBy("to").orderBy(F.desc("n"))) - F.col("of_n")).drop("of_n")
    sums = sums.withColumn("earlier", F.sum("all").over(Window.partitionBy("to", "n").orderBy("lot", "part")) - F.col("all")).drop("all")
    sums = sums.join(gains, ["to", "n"]).select("to", "n", "lot", "part", (F.col("larger") + F.col("earlier")).alias("ahead"))
    before = Window.partitionBy("to", "n", "lot", "part").orderBy("link", "lane", "shard").rowsBetween(Window.unboundedPreceding, -1)
    movers = movers.withColumn("own", F.coalesce(F.sum("n").over(before), F.lit(0))).join(sums, ["to", "n", "lot", "part"]).join(F.broadcast(load.withColumnRenamed("shard", "to")), "to")
    movers = movers.withColumn("go", F.greatest(F.lit(0), F.least(F.col("n"), F.col("room") - F.col("ahead") - F.col("own"))))
    keep = ["link", "lane", "lanes", "group_n"]
    moved = F.struct(F.col("to").alias("shard"), F.col("go").alias("n"), F.col("go").alias("moved"))
    left = F.struct("shard", (F.col("n") - F.col("go")).alias("n"), F.lit(0).cast("long").alias("moved"))
    split = movers.select(*keep, F.explode(F.array(moved, left)).alias("x")).select(*keep, "x.shard", "x.n", "x.moved").where("n > 0")
    stay = wish.where("at_home").select(*keep, "shard", "n", F.lit(0).cast("long").alias("moved"))
    return stay.union(split).groupBy(*keep, "shard").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")).select("link", "lane", "shard", "n", "group_n", "lanes", "moved")


def shard(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows (doc_id, ..., link, row) with shard and slot."""
    spark = rows.sparkSession
    rows = durable(rows)
    total = rows.count()
    quota, extra = divmod(total, shards)
    linked, cells = _cells(rows, shards, quota)
    cells = durable(cells)
    # a group's movers have tried each of its homes when as many rounds moved nothing
    turns = -(-(cells.agg(F.max("group_n")).first()[0] or 0) // max(1, quota))
    idle = 0
    for number in range(rounds if quota else 0):
        cells = durable(_round(cells, quota, shards, number))
        idle = 0 if cells.agg(F.sum("moved")).first()[0] else idle + 1
        if idle >= turns:
            break
    # documents of a lane take its cells' labels in order
    lane = Window.partitionBy("link", "lane").orderBy("row", "doc_id")
    placed = linked.withColumn("at", F.row_number().over(lane) - 1)
    upto = F.sum("n").over(Window.partitionBy("link", "lane").orderBy("shard"))
    spans = cells.select("link", "lane", "shard", upto.alias("hi"), (upto - F.col("n")).alias("lo"))
    placed = placed.join(spans, ["link", "lane"]).where("at >= lo and at < hi").select(*rows.columns, "shard")
    buckets = max(1, total // BUCKET)
    placed = durable(_ranked(placed, ["shard"], max(1, buckets // shards), [F.col("row"), F.col("doc_id")], "slot"))
    limits = spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(quota) + (F.col("id") < extra).cast("int")).alias("limit"))
    placed = placed.join(F.broadcast(limits), "shard")
    kept = placed.where(F.col("slot") < F.col("limit")).drop("limit")
    sizes = linked.select("link").distinct()
    alone = rows.join(sizes, "link", "left_anti")
    free = alone.unionByName(placed.where(F.col("slot") >= F.col("limit")).select(*rows.columns))
    free = _ranked(free.withColumn("all", F.lit(0)), ["all"], buckets, [F.col("row"), F.col("doc_id")], "at").drop("all")
    have = kept.groupBy("shard").agg(F.count("*").alias("have"))
    need = limits.join(have, "shard", "left").withColumn("have", F.coalesce("have", F.lit(0))).withColumn("need", F.col("limit") - F.col("have"))
    need = need.withColumn("hi", F.sum("need").over(Window.orderBy("shard")))
    steps = need.agg(F.lit(0).alias("one"), F.sort_array(F.collect_list(F.struct("shard", "hi", "need", "have"))).alias("steps"))
    hit = F.element_at(F.filter("steps", lambda s: s["hi"] > F.col("at")), 1)
    filled = free.withColumn("one", F.lit(0)).join(F.broadcast(steps), "one").withColumn("hit", hit)
    filled = filled.select(*rows.columns, F.col("hit.shard").alias("shard"), (F.col("at") - (F.col("hit.hi") - F.col("hit.need")) + F.col("hit.have")).alias("slot"))
    return kept.select(*rows.columns, "shard", "slot").unionByName(filled)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; equal texts are linked."""
    return shard(described(docs), shards).select("doc_id", "size", "text_crc32", "shard", "slot")
