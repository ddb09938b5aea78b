"""What large or odd tables showed."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from larkspur import suite, views
from larkspur.functions import text as texts
from larkspur.operators import generation, rollup
from larkspur.operators.index import Index, postings_of
from larkspur.sources import corpus, textfiles


def test_trigrams_of_a_long_text(spark):
    """One pass over the text; a substring for each window took time with the square of its length."""
    long = "".join(random.Random(1).choices("abcdeé😀\n", k=300_000))
    rows = spark.createDataFrame([(0, long), (1, "ab"), (2, None), (3, "A\nb😀c")], "k int, t string").repartition(1)
    began = time.perf_counter()
    got = {r.k: r.found for r in rows.select("k", texts.trigrams(F.col("t")).alias("found")).collect()}
    assert time.perf_counter() - began < 15
    assert sorted(got[0]) == sorted({long[i : i + 3] for i in range(len(long) - 2)})
    assert got[1] == got[2] == [] and got[3] == ["a\nb", "\nb😀", "b😀c"]


def test_proximity_in_a_text_of_one_word(spark):
    """Every token is a start; each start took a pass over all tokens."""
    rows = spark.createDataFrame([(0, ["the"] * 20_000 + ["x", "x", "of"]), (1, ["the"] * 20_000 + ["x", "of"]), (2, ["of", "the"]), (3, ["the", "of", "x", "the", "end"])], "k int, found array<string>").repartition(1)
    near = lambda words, slop: sorted(r.k for r in rows.where(texts.in_order_within(F.col("found"), words, slop)).collect())
    began = time.perf_counter()
    assert near(["the", "of"], 1) == [1, 3] and near(["the", "of"], 2) == [0, 1, 3]
    assert near(["the", "the", "end"], 1) == [] and near(["the", "the", "end"], 2) == [3] and near(["the", "the", "of"], 1) == [1]
    assert time.perf_counter() - began < 15


def test_closure_has_no_limit_of_rows(spark):
    """A recursive query stopped at the row limit of the session that ran it, once the closure was joined with other tables."""
    edges = spark.createDataFrame([(1, None), *((k, k // 2) for k in range(2, 40)), (100, 101), (101, 100), (102, 102), (103, 999)], "object_id long, parent_id long")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        above = generation.closure(edges)
        got = {r.object_id: r.ancestors for r in above.collect()}
        bad = generation.cyclic(above, spark.createDataFrame([(2, 20), (3, 20), (7, 7), (5, 999)], "object_id long, parent_id long")).collect()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
    assert got == {k: [k >> d for d in range(k.bit_length() - 1, 0, -1)] for k in range(1, 40)}
    assert sorted(map(tuple, bad)) == [(2, 20), (7, 7)]


def test_sql_over_all_hits(spark, tmp_path):
    """Statements saw the first 1000 hits only."""
    spark.range(1500).selectExpr("id as doc_id", "if(id % 3 = 0, 'a License', 'b') as text", "'en' as lang", "'s' as source").write.parquet(str(tmp_path / "documents.parquet"))
    store = Index(spark, str(tmp_path / "index"))
    store.build(corpus.docs(spark, str(tmp_path)), corpus.chunks(spark, str(tmp_path)))
    count = lambda text: views.sql(spark, store, "SELECT count(*) AS n, count(DISTINCT entry_id) AS ids FROM {hits}", hits=text).first()
    assert tuple(count("ext:en")) == (1500, 1500) and tuple(count("content:~License")) == (500, 500)
    assert views.catalog_search(store, "ext:en", limit=3).count() == 3 and views.catalog_search(store, "ext:en", offset=1490).count() == 10


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_search_of_files_needs_no_build(spark, small):
    """A query over files built the whole index first: rollups, wide joins and a sort of all entries."""
    for name in ("pred_all", "facet_kind", "exclusion_summary", "under_dir", "descendants", "ancestors_nearest"):
        plan = plan_of(suite.queries()[name](spark, small))
        assert "larkspur-index" not in plan and "Generate explode(ancestors" not in plan, name


def test_documents_join_rollups_to_directories_only(spark, small):
    docs = rollup.entry_documents(corpus.star(spark, small))
    assert "Join" in plan_of(docs) and "Generate explode(ancestors" not in plan_of(docs.where("kind = 'file'"))
    assert "Generate explode(ancestors" not in plan_of(docs.select("entry_id", "path", "kind"))  # no rollup asked for
    files = docs.where("kind = 'file'").select(sorted(set(docs.columns) - {"extension_counts"}))
    assert files.exceptAll(rollup.file_documents(corpus.star_files(spark, small)).select(files.columns)).count() == 0 and files.count() > 5000


def test_scan_of_entries_with_several_names(spark):
    """Two names of one object gave four rows; a scan made every row of the catalog several times over."""
    rows = [(1, 1, 1, None, "directory", "unknown", [], 0), (1, 2, 2, 1, "directory", "unknown", [1], 0), (1, 3, 3, 1, "directory", "unknown", [1], 0), (1, 4, 9, 2, "file", "indexed", [1, 2], 5), (1, 5, 9, 2, "file", "indexed", [1, 2], 5), (1, 6, 6, 3, "file", "indexed", [1, 3], 5), (1, 7, 7, 1, "file", "indexed", [1], 5)]
    schema = "source_id long, entry_id long, object_id long, parent_id long, kind string, content_state string, ancestors array<long>, size long"
    old = spark.createDataFrame(rows, schema).withColumns({c: F.lit(0).cast("long") for c in ("allocated", "attributes", "created", "modified")})
    seen = old.where("entry_id not in (3, 6, 7)").withColumn("size", F.when(F.col("kind") == "file", F.lit(6)).otherwise(F.col("size")).cast("long"))
    entries, state = generation.scan(old, seen, spark.createDataFrame([(1,), (2,), (3,)], "dir_id long"))
    assert sorted((r.entry_id, r.generation) for r in entries.collect()) == [(1, 1), (2, 1), (4, 2), (5, 2)] and state == "complete"
    entries, state = generation.scan(old, seen.withColumn("content_state", F.lit("pending")), spark.createDataFrame([(1,), (2,)], "dir_id long"))
    assert sorted(r.entry_id for r in entries.collect()) == [1, 2, 4, 5] and state == "content_pending"
    entries, state = generation.scan(old, seen, spark.createDataFrame([(2,)], "dir_id long"))
    assert sorted(r.entry_id for r in entries.collect()) == [1, 2, 3, 4, 5, 6, 7] and state == "offline"


def test_extrema_of_touched_directories_are_combined_before_the_join(spark, small):
    """All files are below the root; their rows met in the task that joins it."""
    plan = suite.queries()["rollup_delta_equals_full"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_ranked_search_needs_no_build(spark, small):
    """One ranked query over documents built the whole index first."""
    for name in ("content_ranked_bm25", "content_ranked_page"):
        assert "larkspur-index" not in plan_of(suite.queries()[name](spark, small)), name


def test_postings_are_counted_in_their_chunk(spark):
    """Occurrences were counted by a shuffle of all tokens."""
    chunks = spark.createDataFrame([(1, 1, 0, "b a B c b"), (1, 1, 1, "a"), (2, 1, 0, " -- "), (3, 1, 0, None)], "object_id long, generation long, ordinal int, text string")
    postings, lengths = postings_of(chunks)
    assert sorted(map(tuple, postings.collect())) == [("a", 1, 0, 1), ("a", 1, 1, 1), ("b", 1, 0, 3), ("c", 1, 0, 1)]
    assert "Aggregate" not in plan_of(postings) and postings.schema["tf"].dataType.simpleString() == "bigint" and lengths.count() == 4


def test_chunks_come_in_batches_of_bounded_size(spark):
    """Each text made a table of its own, however short; all chunks of a long one came at once."""
    rows = [(k, 1, "line\n" * k) for k in range(2500)] + [(9999, 2, ("x" * 99 + "\n") * 40_000), (10_000, 1, None), (10_001, 1, "")]
    texts_ = spark.createDataFrame(rows, "object_id long, generation long, text string").repartition(1)
    sizes = textfiles.chunked(texts_).select("text").mapInArrow(lambda bs: (pa.RecordBatch.from_pylist([{"n": b.num_rows, "b": b.nbytes}]) for b in bs), "n long, b long").collect()
    assert len(sizes) < 40  # 2500 before
    got = {(r.object_id, r.generation): (r.n, r.bytes, r.lines) for r in textfiles.chunked(texts_).groupBy("object_id", "generation").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.sum("lines").alias("lines")).collect()}
    assert got[(7, 1)] == (1, 35, 7) and got[(9999, 2)] == (244, 4_000_000, 40_000) and len(got) == 2500
    chunks = textfiles.chunked(texts_).where("object_id = 9999").orderBy("ordinal").collect()
    assert "".join(c.text for c in chunks) == rows[2500][2] and [c.ordinal for c in chunks] == list(range(244))


def test_day_of_a_time_before_1970(spark):
    """Days are floored, as the reference's are (div_euclid), also before 1970."""
    day = 86_400 * 10**9
    rows = spark.createDataFrame([(-2800 * 10**9,), (-day,), (-1,), (0,), (day + 1,)], "t long")
    assert [r.d for r in rows.select(texts.utc_day(F.col("t")).alias("d")).collect()] == [-day, -day, -day, 0, day]
