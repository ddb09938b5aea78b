"""Catalogs derived from the driver's tables.

star: region / nation / customer / order are directories, line items are files.
docs: documents are files of /docs/<source>/<lang>/, with their text as content.
web: pages are files of /web/<host>/<path of the url>.
people: customers are files of /Crm/<segment>/ on two sources, with capitals in their names, some of them hidden.

An entry: source_id, entry_id, object_id, parent_id, name, path, kind, extension, size, allocated, modified, created,
attributes, content_state, ancestors (root first), listed. Times are nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import extension_of

ROOT, REGION, NATION, CUSTOMER, ORDER, FILE = 1, 10, 100, 10**6, 10**9, 10**12
STAR, DOCS, WEB, PEOPLE = 1, 2, 3, 11
DAY_NS = 86_400 * 10**9
DOCS_EPOCH = 1_700_000_000 * 10**9
CLUSTER = 4096

ENTRY = ["source_id", "entry_id", "object_id", "parent_id", "name", "path", "kind", "extension", "size", "allocated", "modified", "created", "attributes", "content_state", "ancestors", "listed"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(t: Column) -> Column:
    """Nanoseconds since 1970 of a time (without or with a zone)."""
    return F.unix_micros(t.cast("timestamp")) * 1000


def clusters(size: Column) -> Column:
    return (F.ceil(size / F.lit(float(CLUSTER))) * CLUSTER).cast("long")


def _entry(df: DataFrame, **columns: Column) -> DataFrame:
    types = {"name": "string", "path": "string", "kind": "string", "extension": "string", "content_state": "string", "ancestors": "array<bigint>", "listed": "boolean"}
    return df.select(*(columns[c].cast(types.get(c, "long")).alias(c) for c in ENTRY))


def _directory(df: DataFrame, id_: Column, parent: Column, name: Column, path: Column, ancestors: Column) -> DataFrame:
    none = F.lit(None)
    return _entry(
        df, source_id=F.lit(STAR), entry_id=id_, object_id=id_, parent_id=parent, name=name, path=path, kind=F.lit("directory"), extension=F.lit(""), size=F.lit(0), allocated=F.lit(0),
        modified=none, created=none, attributes=F.lit(16), content_state=F.lit("unknown"), ancestors=ancestors, listed=F.lit(True),
    )


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's nation: keys only, as what is joined by key is shuffled."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


def _placed(rows: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of _ordered() and what was joined to them, with the ids and names of the directories above orders. Nations and regions are a few dozen rows."""
    spark = rows.sparkSession
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = nation.select("n_nationkey", (F.lit(REGION) + F.col("r_regionkey")).cast("long").alias("r"), (F.lit(NATION) + F.col("n_nationkey")).cast("long").alias("n"), F.concat(F.lit("/star/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit("/cust-")).alias("_place"))
    prefix = F.concat("_place", F.col("o_custkey").cast("string"), F.lit("/order-"), F.col("o_orderkey").cast("string"))
    found = rows.join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    return found.withColumns({"c": F.lit(CUSTOMER) + F.col("o_custkey"), "o": F.lit(ORDER) + F.col("o_orderkey"), "prefix": prefix}).drop("_place", "n_nationkey", "c_nationkey")


def star_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the ids and names of the directories above them; the dimensions are small or joined by key."""
    return _placed(_ordered(spark, sf_dir), sf_dir).select("o_orderkey", "r", "n", "c", "o", "prefix")


def star_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _placed(read(spark, sf_dir, "lineitem").join(_ordered(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")), sf_dir)
    id_ = F.lit(FILE) + F.col("l_orderkey") * 10**7 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    ext = F.lower("l_returnflag")
    name = F.concat(F.lit("part-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("."), ext)
    size = F.floor("l_extendedprice")
    state = F.when(F.col("l_returnflag") == "R", "excluded").when(F.col("l_linestatus") == "F", "indexed").otherwise("pending")
    bits = F.lit(32) + F.when(F.col("l_linenumber") == 7, 2).otherwise(0) + F.when(F.col("l_tax") == 0, 1).otherwise(0)
    return _entry(
        lines, source_id=F.lit(STAR), entry_id=id_, object_id=id_, parent_id=F.col("o"), name=name, path=F.concat("prefix", F.lit("/"), name), kind=F.lit("file"), extension=ext, size=size,
        allocated=clusters(size), modified=nanos(F.col("l_shipdate")), created=nanos(F.col("l_shipdate")) - DAY_NS, attributes=bits, content_state=state,
        ancestors=F.array(F.lit(ROOT).cast("long"), "r", "n", "c", "o"), listed=F.lit(True),
    )


def star_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root, regions, nations, customers and orders."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    root = F.lit(ROOT).cast("long")
    rid, nid = (F.lit(REGION) + F.col("r_regionkey")).cast("long"), (F.lit(NATION) + F.col("n_nationkey")).cast("long")
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    customer = read(spark, sf_dir, "customer").join(both, F.col("c_nationkey") == F.col("n_nationkey"))
    cid = F.lit(CUSTOMER) + F.col("c_custkey")
    rpath = F.concat(F.lit("/star/"), F.lower("r_name"))
    npath = F.concat(rpath, F.lit("/"), F.lower("n_name"))
    cname = F.concat(F.lit("cust-"), F.col("c_custkey").cast("string"))
    orders = star_levels(spark, sf_dir)
    oname = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    none = F.array().cast("array<bigint>")
    parts = [
        _directory(spark.range(1), root, F.lit(None), F.lit("star"), F.lit("/star"), none),
        _directory(region, rid, root, F.lower("r_name"), rpath, F.array(root)),
        _directory(both, nid, rid, F.lower("n_name"), npath, F.array(root, rid)),
        _directory(customer, cid, nid, cname, F.concat(npath, F.lit("/"), cname), F.array(root, rid, nid)),
        _directory(orders, F.col("o"), F.col("c"), oname, F.col("prefix"), F.array(root, F.col("r"), F.col("n"), F.col("c"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_directories(spark, sf_dir).unionByName(star_files(spark, sf_dir))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of documents, and their text; content is indexed."""
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    path = F.concat(F.lit("/docs/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), name)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    modified = F.lit(DOCS_EPOCH) - F.col("doc_id") * (DAY_NS // 24)
    return _entry(
        d, source_id=F.lit(DOCS), entry_id=F.col("doc_id"), object_id=F.col("doc_id"), parent_id=F.lit(None), name=name, path=path, kind=F.lit("file"), extension=F.col("lang"), size=size, allocated=clusters(size),
        modified=modified, created=modified, attributes=F.lit(32), content_state=F.lit("indexed"), ancestors=F.array().cast("array<bigint>"), listed=F.lit(True),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, generation, ordinal, text: each document's text as one chunk."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.lit(1).cast("long").alias("generation"), F.lit(0).alias("ordinal"), "text")


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    path = F.concat(F.lit("/web/"), F.regexp_replace(bare, r"/+$", ""))
    name = F.element_at(F.split(path, "/"), -1)
    size = F.octet_length("html")
    modified = F.lit(DOCS_EPOCH) + F.col("page_id") * (DAY_NS // 24)
    return _entry(
        p, source_id=F.lit(WEB), entry_id=F.col("page_id"), object_id=F.col("page_id"), parent_id=F.lit(None), name=name, path=path, kind=F.lit("file"), extension=extension_of(name), size=size, allocated=clusters(size),
        modified=modified, created=modified, attributes=F.lit(32), content_state=F.lit("pending"), ancestors=F.array().cast("array<bigint>"), listed=F.lit(True),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with capitals, two sources (11 and 12), hidden and system files."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    name = F.concat("c_name", F.lit(".Vcf"))
    size = F.floor(F.abs("c_acctbal"))
    bits = F.lit(32) + F.when(key % 5 == 0, 2).otherwise(0) + F.when(key % 7 == 0, 4).otherwise(0)
    state = F.when(key % 3 == 0, "pending").when(key % 3 == 1, "indexed").otherwise("failed")
    modified = F.lit(DOCS_EPOCH) - key * (DAY_NS // 24)
    return _entry(
        c, source_id=F.lit(PEOPLE) + F.col("c_nationkey") % 2, entry_id=key + 1, object_id=key + 1, parent_id=F.lit(None), name=name, path=F.concat(F.lit("/Crm/"), "c_mktsegment", F.lit("/"), name), kind=F.lit("file"),
        extension=F.lit("vcf"), size=size, allocated=clusters(size), modified=modified, created=modified, attributes=bits, content_state=state, ancestors=F.array().cast("array<bigint>"), listed=F.lit(True),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events: seq, object_id, op, generation-bearing value; ordered by (ts, event_id)."""
    ops = F.create_map(*[F.lit(x) for kv in {"signup": "link", "view": "upsert", "click": "rename", "purchase": "content", "error": "delete"}.items() for x in kv])
    return read(spark, sf_dir, "events").select("event_id", nanos(F.col("ts")).alias("at"), F.col("user_id").alias("object_id"), F.element_at(ops, F.col("event_type")).alias("op"), F.floor("value").cast("long").alias("size"))
