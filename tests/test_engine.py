"""Golden trees, content, regex plans, sources, feeds and publishing."""

import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.operators import content, generation, policy, rollup, search
from larkspur.plans import ast as q
from larkspur.plans.parser import parse
from larkspur.plans.regexplan import required_literals
from larkspur.sources import archives, export, listing, textfiles
from larkspur.streaming import feed, ledger

FILES = {
    "atlas/maps/north.tile": 40, "atlas/maps/south.tile": 60, "atlas/code/Draw.cs": 300, "atlas/code/lib/Paths.cs": 250, "atlas/NOTES.md": 70, "atlas/code/Two.DMP": 3000,
    "tools/gen/Build.cs": 90, "tools/todo.txt": 12, "hosts/10.7.0.4/a.bin": 700, "hosts/10.7.0.4/b.bin": 800, "hosts/10.7.0.4 (1)/a.bin": 900, "hosts/10.7.0.5/c.bin": 5000,
    "crash/one.dmp": 2000, "mail/Rx.log": 15, "mail/RX-queue.txt": 25, "mail/Quarterly report.md": 35,
}


@pytest.fixture(scope="module")
def tree(spark):
    ids, rows = {"": 1}, []

    def add(path, kind, size):
        parent, _, name = path.rpartition("/")
        if path and parent not in ids:
            add(parent, "directory", 0)
        ids.setdefault(path, len(ids) + 1)
        above, at = [], path
        while at:
            at = at.rpartition("/")[0]
            above.insert(0, ids[at])
        ext = name.rpartition(".")[2].lower() if kind == "file" and "." in name else ""
        rows.append((1, ids[path], ids[path], above[-1] if above else None, name, f"/{path}".rstrip("/"), kind, ext, size, size, 5 if kind == "file" else None, None, 0, "indexed", above, True))

    add("", "directory", 0)
    for path, size in FILES.items():
        add(path, "file", size)
    schema = "source_id long, entry_id long, object_id long, parent_id long, name string, path string, kind string, extension string, size long, allocated long, modified long, created long, attributes long, content_state string, ancestors array<long>, listed boolean"
    docs = rollup.entry_documents(spark.createDataFrame(rows, schema)).cache()
    docs.count()
    return docs, ids


@pytest.mark.parametrize("text, mode, names", [
    ("ext:dmp", "files", {"one.dmp", "Two.DMP"}), ("*.dmp", "files", {"one.dmp", "Two.DMP"}), ("has:tile has:cs", "directories", {"atlas", ""}), ("has:cs>=3 has:tile", "directories", {""}), ("has:cs>=4 has:tile", "directories", set()),
    ("name:=Rx.log", "files", {"Rx.log"}), ("name:=rx.log", "files", set()), ("name:=irx.log", "files", {"Rx.log"}), ("name:~Rx", "files", {"Rx.log"}), ("name:~rx", "files", set()), ("name:rx", "files", {"Rx.log", "RX-queue.txt"}),
    ("quarterly report", "files", {"Quarterly report.md"}), ('"quarterly report"', "files", {"Quarterly report.md"}), ("ext:cs -path:lib", "files", {"Draw.cs", "Build.cs"}), ("ext:cs && -path:lib", "files", {"Draw.cs", "Build.cs"}),
    (r"name:/^10\.7\.0\.4( \(\d+\))?$/", "directories", {"10.7.0.4", "10.7.0.4 (1)"}), ("kind:dir subtree:>4k", "directories", {"", "hosts", "10.7.0.5"}),
])
def test_golden(tree, text, mode, names):
    found, _ = search.matches(tree[0], search.Request(text, mode))
    assert {r.name for r in found.select("name").collect()} == names


def test_page_facets_tight(tree):
    docs, ids = tree
    page = search.search(docs, search.Request("ext:bin", sort="size", descending=True, limit=2))
    assert [r["size"] for r in page.hits.collect()] == [5000, 900]
    after = search.Request("ext:bin", sort="size", descending=True, limit=2, cursor=page.cursor)
    assert [r["size"] for r in search.search(docs, after).hits.collect()] == [800, 700]
    late = search.search(docs, search.Request("ext:bin", sort="size", descending=True, limit=2, cursor=page.cursor, generation=4))
    assert late.warnings and not search.search(docs, after).warnings
    found, node = search.matches(docs, search.Request("has:tile has:cs", "directories"))
    assert {(r.name, r.score) for r in search.scored(found, node, None, "directories").collect()} == {("atlas", 1.0), ("", 0.5)}
    every, _ = search.matches(docs, search.Request("*", "files"))
    assert {r.value: r.n for r in search.facet_terms(every, "extension").collect()} == {"bin": 4, "cs": 3, "txt": 2, "dmp": 2, "md": 2, "tile": 2, "log": 1}
    assert search.facet_page(every, "extension", 2) == ([("bin", 4), ("cs", 3)], True)
    counts = {r.bucket: r.n for r in search.facet_sizes(every).collect()}
    assert sum(counts.values()) == 16
    for bucket, clause in search.size_clauses().items():
        assert search.matches(docs, search.Request(clause, "files"))[0].count() == counts.get(bucket, 0), clause
    assert [r.name for r in search.search(docs, search.Request("rx", "files")).hits.collect()] == ["Rx.log", "RX-queue.txt"]
    atlas = docs.where("name = 'atlas'").first()
    assert (atlas.file_count, atlas.subtree_logical) == (6, 3720)
    assert {r.name for r in search.matches(docs, search.Request(f"in:o:{ids['atlas/code']} kind:file"))[0].collect()} == {"Draw.cs", "Paths.cs", "Two.DMP"}
    assert search.matches(docs, search.Request(f"in:o:{ids['atlas/code']}~1 kind:file"))[0].count() == 2
    assert [r.name for r in search.children(docs, ids["atlas"]).collect()] == ["code", "maps", "NOTES.md"]
    assert search.resolve(docs, "/ATLAS/code").first().entry_id == ids["atlas/code"]


def test_cursor():
    r = search.Request("ext:bin", limit=10)
    text = search.Cursor.next(r, 3, 17)
    assert search.Cursor.read(text, r) == (10, 3, 17)
    for other in (search.Request("ext:txt", limit=10), search.Request("ext:bin", mode="files")):
        with pytest.raises(q.QueryError):
            search.Cursor.read(text, other)
    with pytest.raises(q.QueryError):
        search.Cursor.read(text[:-6] + "AAAAAA", r)


def test_clause_editing():
    assert search.with_clause("a OR b", "ext:cs") == "(a OR b) ext:cs"
    assert search.with_clause("", "ext:cs", True) == "-ext:cs"
    assert parse(search.without_clause("ext:cs ext:md", "ext:md")) == parse("ext:cs")


CHUNKS = [(1, 1, 0, "Harbor started\nWv responded with build 4.2.1\ndone"), (2, 1, 0, "line one\nwv here, Wved there"), (3, 1, 0, "fn main() { println!(\"hello world\"); }"), (4, 1, 0, "Harbor readme"), (5, 1, 0, "a" * 50), (5, 2, 0, "marker-04c1e found")]


@pytest.mark.parametrize("text, ids", [
    ("content:Harbor", {1, 4}), ("content:=Wv", {1}), ("content:=WV", set()), ("content:=wv", {2}), ("content:~Wv", {1, 2}), ('content:="Wv responded"', {1}), ('content:"hello world"', {3}), ('content:"world hello"', set()), ('content:"fn println"~1', {3}), ('content:"hello fn"~5', set()),
    (r"content:/Wv\w+/c", {2}), (r"content:/marker-[0-9a-f]+/", {5}), (r"content:/x*/", set()), ("content:/build \\d\\.\\d/", {1}),
])
def test_content(spark, text, ids):
    chunks = content.latest(spark.createDataFrame(CHUNKS, "object_id long, generation long, ordinal int, text string"))
    entries = spark.createDataFrame([(i,) for i in range(1, 6)], "object_id long")
    clauses = [n for n in q.walk(parse(text)) if isinstance(n, q.Text)]
    flagged = content.with_flags(entries, chunks, clauses).where("_content_0")
    assert {r.object_id for r in flagged.collect()} == ids


def test_snippet_preview(spark):
    chunks = spark.createDataFrame(CHUNKS, "object_id long, generation long, ordinal int, text string")
    hit = content.snippets(chunks, "responded").first()
    assert (hit.line, hit.snippet[hit.start : hit.stop]) == (1, "responded")
    rows = spark.createDataFrame([(1, 1, i, f"x{i}\x00") for i in range(20)], "object_id long, generation long, ordinal int, text string")
    seen = content.preview(rows, 1, 1, 10, 2, 9).orderBy("ordinal").collect()
    assert [(r.ordinal, r.text, r.has_before) for r in seen] == [(9, "x9�", True), (10, "x10�", True)]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([r"timed? ?out after \d+", r"(error|warn)ing: \w+", r"connection (refused|reset)", r"[A-Z][a-z]+Exception: ", r"(ab|cd)+ef", r"x{3}y?z", r"a(bc)*d", r"straße|STRASSE", r"^foo.*bar$"]), st.data())
def test_regex_plan_is_a_superset(pattern, data):
    import re

    text = data.draw(st.from_regex(re.compile(pattern, re.I | re.A)))
    lowered = text.lower()
    for choices in required_literals(pattern, False):
        assert any(c in lowered for c in choices), (pattern, text, choices)


def test_ranked_objects_all(spark):
    """Every matching object has a score, however many match."""
    scores = spark.range(5_003).selectExpr("id AS object_id", "0 AS ordinal", "1.0D + id AS score")
    ranked = content.ranked_objects(scores)
    assert ranked.count() == 5_003 and ranked.where("object_id = 0").first().score == 1.1
    assert content.ranked_objects(scores, 10).count() == 10


def test_text_files():
    assert textfiles.sniff(b"plain") == "utf-8" and textfiles.sniff("ü".encode("cp1252") + b"bc") == "cp1252"
    assert textfiles.sniff(b"\xff\xfea\0") == "utf-16" and textfiles.sniff("hello there".encode("utf-16-le")) == "utf-16-le" and textfiles.sniff(bytes(range(200))) is None
    text = "".join(f"line {i} ä\n" for i in range(9000)) + "x" * 600_000
    rows = list(textfiles.chunk_lines(text))
    assert "".join(r["text"] for r in rows) == text and rows[-1]["byte_end"] == len(text.encode())
    assert all(a["byte_end"] == b["byte_start"] for a, b in zip(rows, rows[1:])) and sum(r["lines"] for r in rows) == 9000
    data = (b"".join(bytes([i * 7 % 251, i * i % 256]) for i in range(90_000)))
    ends = textfiles.cut_points(data)
    assert ends[-1] == len(data) and all(b - a <= textfiles.CDC_MAX for a, b in zip([0, *ends], ends))


def test_archives(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("readme.txt", "hi")
        z.writestr("src/lib/mod.rs", "fn")
        z.writestr("../escape.txt", "x")
    rows = archives.inventory("t.zip", buffer.getvalue())
    by_path = {r[2]: r for r in rows}
    assert set(by_path) == {"readme.txt", "src/lib/mod.rs", "escape.txt", "src", "src/lib"} and by_path["src"][7] and by_path["escape.txt"][14] == archives.FLAGS["traversal"]
    assert archives.inventory("b.zip", b"junk")[0][-1]
    files = spark.createDataFrame([("t.zip", buffer.getvalue()), ("b.zip", b"junk")], "path string, content binary")
    assert archives.members(files).where("error is null").count() == 5


def test_archives_of_many_members(spark):
    """All members and the directories that they imply."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for i in range(100_003):
            z.writestr(zipfile.ZipInfo(f"d{i // 50_000}/{i}"), "")
    files = spark.createDataFrame([("t.zip", buffer.getvalue()), ("b.zip", b"junk")], "path string, content binary")
    found = archives.members(files)
    assert found.where("not implicit").count() == 100_003 and {r.path for r in found.where("implicit").collect()} == {"d0", "d1", "d2"}
    assert found.where("error is not null").count() == 1


def test_listing(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one.txt").write_text("x" * 100)
    (tmp_path / "a/b/two.txt").write_text("y")
    (tmp_path / "top.txt").write_text("z")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    rows = {r.path.removeprefix(str(tmp_path)): r.kind for r in listing.tree(spark, str(tmp_path)).collect()}
    assert rows == {"": "directory", "/a": "directory", "/a/b": "directory", "/a/one.txt": "file", "/a/b/two.txt": "file", "/top.txt": "file", "/link": "reparse"}


def test_export(spark):
    hits = spark.createDataFrame([(1, 1, 'a,"b"', 2**60)], "object_id long, entry_id long, name string, size long")
    assert export.csv_lines(hits).first().value.startswith('1,1,,,"a,""b""",,')
    lines = [json.loads(x) for x in export.ndjson(hits, "*")]
    assert lines[1]["size"] == str(2**60) and lines[-1]["rows_exported"] == 1 and not lines[-1]["truncated"]


EVENTS = "event_id long, at long, object_id long, op string, size long"


def test_feed(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, 7, "link", 1), (2, 2, 7, "delete", 1), (3, 1, 8, "upsert", 2), (4, 2, 8, "delete", 2), (5, 3, 8, "link", 3), (6, 1, 9, "delete", 0)], EVENTS)
    got = {r.object_id: (r.last_op, r.reasons) for r in feed.coalesced(events).collect()}
    assert got == {8: ("link", 3), 9: ("delete", 16)}
    fence = feed.Fence()
    assert fence.advance(0, 5) and not fence.advance(0, 9) and fence.advance(5, 9)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    feed.follow(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.object_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {8, 9}


def test_admission():
    have = ledger.Position(2, 10, "h")
    assert [ledger.admit(have, *x) for x in ((1, 0, "", 5), (3, 0, "", 5), (2, 5, "", 10), (2, 5, "", 15), (2, 12, "", 15), (2, 10, "x", 15), (2, 10, "h", 15))] == ["full_resync_required"] * 2 + ["already_applied", "stale", "gap", "history_fork", "apply"]


def test_publish(spark, tree):
    docs, ids = tree
    seen = docs.where(F.col("object_id") != ids["atlas/code"]).select("entry_id")
    listed = docs.where("kind = 'directory'").select(F.col("object_id").alias("dir_id"))
    dead = {r.path for r in generation.published(docs, seen, listed).where("not live").collect()}
    assert dead == {"/atlas/code", "/atlas/code/Draw.cs", "/atlas/code/lib", "/atlas/code/lib/Paths.cs", "/atlas/code/Two.DMP"}
    kept = generation.published(docs, seen, listed.where(F.col("dir_id") != ids["atlas"]))
    assert kept.where("not live").count() == 0
    assert generation.final_state(0, True, 3) == "content_pending" and generation.final_state(1, True, 0) == "degraded"
    up = generation.upserted(spark.createDataFrame([(1, "a", 5), (1, "b", 6), (1, "c", 7)], "parent_id long, name string, object_id long"), spark.createDataFrame([(1, "a", 5), (1, "b", 9), (1, "d", 8)], "parent_id long, name string, object_id long"))
    assert {r.name: r.action for r in up.collect()} == {"a": "refresh", "b": "replace", "c": "remove", "d": "insert"}


def test_policy(spark, tree):
    rules = [("prefix", "/atlas", False), ("regex", "paths", True)]
    got = {r.entry_id: r.reason for r in policy.decided(tree[0], rules).collect()}
    ids = tree[1]
    assert got[ids["atlas/NOTES.md"]] == "user_exclude" and got[ids["atlas/code/lib/Paths.cs"]] == "" and got[ids["crash/one.dmp"]] == "binary_data" and got[ids["tools/todo.txt"]] == ""


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 100))
def test_delta_equals_full(spark, small, part):
    from larkspur.sources import corpus

    star = corpus.star(spark, small)
    moved = (F.col("kind") == "file") & (F.col("size") % 101 <= part)
    got = rollup.apply_deltas(rollup.subtree_rollup(star.where(~moved)), rollup.rollup_deltas(star.where(moved).withColumn("sign", F.lit(1))), star)
    assert got.exceptAll(rollup.subtree_rollup(star)).count() == 0
