"""Kinds, policy, chunks, stored index, ledger, feeds and exports against known answers and plain versions."""

import hashlib
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspur import views
from larkspur.functions import text as texts
from larkspur.functions.classify import is_text_candidate, kind_of
from larkspur.operators import content, generation, index, lookups, policy, search
from larkspur.plans import ast as q
from larkspur.plans.parser import instant, parse, time_bounds
from larkspur.plans.render import render, rfc3339
from larkspur.sources import archives, corpus, export, textfiles
from larkspur.storage import Manifest
from larkspur.streaming import ledger, watch


def test_kinds(spark):
    known = {"log": "log", "csv": "data", "md": "text", "r": "code", "a": "binary", "vhdx": "disk_image", "zip": "archive", "pdf": "document", "mp3": "media", "sqlite": "database", "html": "markup", "": "unknown", "zzz": "unknown"}
    rows = spark.createDataFrame([(k,) for k in known], "extension string").select("extension", kind_of(F.col("extension")).alias("kind"), is_text_candidate(F.col("extension")).alias("text")).collect()
    assert {r.extension: r.kind for r in rows} == known
    assert {r.extension for r in rows if r.text} == {"log", "csv", "md", "r", "html", "", "zzz"}


def test_policy_order(spark):
    paths = {
        "/store/x.md": (0, "self_store"), "/a/link.md": (1024, "symlink"), "/pagefile.sys": (0, "swap_or_hibernation"), "/a/pagefile.sys": (0, "binary_data"), "/a/cold.md": (4096, "binary_data"), "/web/node_modules/b/i.js": (0, "dependency_cache"),
        "/$Recycle.Bin/x.txt": (0, "recycle_bin"), "/a/$Recycle.Bin/x.txt": (0, ""), "/u/.nuget/packages/p.txt": (0, "dependency_cache"), "/u/packages/p.txt": (0, ""), "/System Volume Information/t.txt": (0, "system_volume_information"),
        "/a/film.mp4": (0, "media_file"), "/a/disk.vhd": (0, "vm_disk_image"), "/a/app.exe": (0, "binary_data"), "/a/doc.pdf": (0, "unsupported"), "/a/pack.zip": (0, ""), "/a/pack.rar": (0, "unsupported"), "/a/keep/film.mp4": (0, ""), "/a/drop/x.md": (0, "user_exclude"), "/w/Windows/Installer/x.txt": (0, "package_artifact"),
    }
    rows = [(i, i, p, p.rpartition("/")[2], p.rpartition(".")[2], "file", 1, bits, "pending") for i, (p, (bits, _)) in enumerate(paths.items())]
    entries = spark.createDataFrame(rows, "entry_id long, object_id long, path string, name string, extension string, kind string, size long, attributes long, content_state string")
    rules = [("prefix", "/a/drop", False), ("regex", "^/a/KEEP/", True)]
    got = {r.entry_id: r.reason for r in policy.decided(entries, rules, protected=["/store"]).collect()}
    assert [got[i] for i in range(len(paths))] == [want for _, want in paths.values()]
    assert policy.rules_preview(entries, rules, most=3).count() == 3
    with pytest.raises(ValueError):
        policy.decision([("prefix", "/x", True)] * 101)


def plain_cuts(data, least=4096, mean=16_384, most=65_536):
    out, state, length, start = [], 0, 0, 0
    for i, byte in enumerate(data):
        length += 1
        if length < least:
            continue
        state = (state * 2 + int(textfiles._GEAR[byte])) % 2**64
        mask = 2**15 - 1 if length < mean else 2**13 - 1
        if state & mask == 0 or length >= most:
            out.append(i + 1)
            state, length, start = 0, 0, i + 1
    return out + ([len(data)] if start < len(data) else [])


def test_chunks():
    rng = random.Random(4)
    for data in (rng.randbytes(400_000), bytes(300_000), b"abcdefgh" * 30_000, b"x" * 4095, b"", rng.randbytes(4096)):
        assert textfiles.cut_points(data) == plain_cuts(data)
    for text in ("a\r\nb\rc\n", "one\u2028two\x85three\x0cfour\n" * 3000, "é" * 300_000 + "\n" + "z" * 20_000, "\n" * 40_000, "no end"):
        rows = list(textfiles.chunk_lines(text))
        assert "".join(r["text"] for r in rows) == text and rows[0]["byte_start"] == 0 and rows[-1]["byte_end"] == len(text.encode())
        assert all(a["byte_end"] == b["byte_start"] and b["first_line"] == a["first_line"] + a["lines"] for a, b in zip(rows, rows[1:]))
        assert all(len(r["text"].encode()) == r["byte_end"] - r["byte_start"] and r["lines"] == r["text"].count("\n") for r in rows)
        assert all(r["text"].endswith("\n") for r in rows[:-1] if not r["split_line"])
    assert [r["split_line"] for r in textfiles.chunk_lines("é" * 300_000)] == [True, True, True] and list(textfiles.chunk_lines("")) == []
    assert textfiles.looks_textual(b"") is None and textfiles.looks_textual(b"text\n") and not textfiles.looks_textual(b"a\0b") and not textfiles.looks_textual(b"\x01" * 20 + b"a" * 80)


def test_times_and_sizes():
    now, day = 1_787_000_000 * 10**9, 86_400 * 10**9
    assert time_bounds("2hours", now) == (now - 7200 * 10**9, now + 1) and time_bounds(">=1.5d", now) == (now - day * 3 // 2, None)
    low, high = instant("2020-01-01T00:00:00.000000001Z"), instant("2020-01-01T02:00:00+01:00")
    assert (low, high) == (1_577_836_800 * 10**9 + 1, 1_577_840_400 * 10**9)
    tree = parse(f"mtime:>={rfc3339(low)},<{rfc3339(high)}", now)
    assert (tree.after, tree.before) == (low, high) and parse(render(tree), now) == tree
    assert parse("size:<0").high == 0 and (parse("size:2k..1k").low, parse("size:2k..1k").high) == (2048, 1024)
    assert parse("a && b") == parse("a b") and search.query_shape("ext:cs name:x") == "name" and search.query_shape("content:~x | ext:c") == "content_regex" and search.query_shape("content:x") == "content_ranked"
    assert search.query_hash(" a  b ") == search.query_hash("a b") != search.query_hash("ab") and texts.fnv1a(b"") == 0xCBF29CE484222325 and texts.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    for clause in search.age_clauses(now).values():
        assert parse(render(parse(clause, now)), now) == parse(clause, now)


def test_archive_flags(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in ("../up.txt", "/abs.txt", "C:/drive.txt", "tab\tname.txt", "twice.txt", "twice.txt", "..", "d/inner.txt"):
            z.writestr(zipfile.ZipInfo(name), "x")
    found = archives.members(spark.createDataFrame([("t.zip", buffer.getvalue()), ("b.zip", b"junk")], "path string, content binary")).cache()
    flags = {r.raw_name: r.flags for r in found.where("ordinal is not null and not implicit").collect()}
    assert flags == {"../up.txt": 1, "/abs.txt": 2, "C:/drive.txt": 2, "tab\tname.txt": 8, "twice.txt": 16, "..": 65, "d/inner.txt": 0}
    records = {r.container: r for r in archives.records(found).collect()}
    assert (records["t.zip"].member_count, records["t.zip"].implicit_dir_count, records["t.zip"].state, records["b.zip"].state) == (8, 1, "complete", "failed")
    total = archives.stats(archives.records(found)).first()
    assert (total.archives, total.members, total.failed) == (2, 8, 1)
    assert [r.name for r in archives.listed(found, "t.zip", limit=3).collect()] == ["d", "", "abs.txt"] and [r.path for r in archives.listed(found, "t.zip", prefix="d").collect()] == ["d/inner.txt", "d"][::-1]


def test_index(spark, small, tmp_path):
    store = index.Index(spark, str(tmp_path / "index"))
    docs, chunks = corpus.docs(spark, small), corpus.chunks(spark, small)
    assert store.build(docs, chunks, {2: 7}) and store.behind({2: 7, 3: 1}) == [3]
    request = search.Request("content:license ext:en", "files", limit=50)
    direct = search.search(search_documents(docs), request, chunks).hits.select("entry_id", F.round("score", 9).alias("s")).collect()
    assert store.search(request).hits.select("entry_id", F.round("score", 9).alias("s")).collect() == direct and len(direct) > 0
    assert store.bm25("license nowhere").count() == 0 and store.bm25("").count() == 0
    some = store.entries().where("entry_id < 5").withColumn("size", F.lit(1).cast("long"))
    gone = store.entries().where("entry_id = 9").select("object_id")
    assert store.applied(some, gone, 4) and not store.applied(some, gone, 4)
    assert store.entries().count() == docs.count() - 1 and store.entries().where("size = 1").count() == 5
    new = spark.createDataFrame([(3, 2, 0, "fresh words"), (4, 1, 0, "stale words")], "object_id long, generation long, ordinal int, text string")
    assert store.store_content(spark.createDataFrame([(3, 2), (4, 2)], "object_id long, generation long"), new)
    assert [r.text for r in store.chunks().where("object_id in (3, 4)").collect()] == ["fresh words"] and [r.object_id for r in store.bm25("fresh").collect()] == [3]
    views.register(spark, store)
    assert spark.sql("SELECT count(*) AS n FROM catalog_entries").first().n == docs.count() - 1
    assert spark.sql("SELECT byte_end FROM chunk_text('abc')").first().byte_end == 3
    assert views.catalog_search(store, "ext:en", limit=3).columns == views.HIT


def search_documents(entries):
    from larkspur.operators import rollup

    return rollup.entry_documents(entries)


def test_manifest(spark, tmp_path):
    a, b = (Manifest(spark, str(tmp_path / "m")) for _ in range(2))
    assert a.current() == (0, {}) and a.advance(0, {"x": 1}) and not b.advance(0, {"x": 2}) and b.current() == (1, {"x": 1}) and b.advance(1, {"x": 3}) and not a.advance(1, {})


def test_highlights(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "first line\nThe Harbor light and harbor wall"), (1, 1, 1, "none"), (2, 1, 0, "x" * 300 + " harbor")], "object_id long, generation long, ordinal int, text string")
    clauses = [n for n in q.walk(parse("content:harbor content:~light")) if isinstance(n, q.Text)]
    got = {r.object_id: r for r in content.highlighted(chunks, clauses).collect()}
    assert got[1].line == 1 and [got[1].snippet[h.start : h.stop] for h in got[1].highlights] == ["Harbor", "light", "harbor"]
    assert [got[2].snippet[h.start : h.stop] for h in got[2].highlights] == ["harbor"] and len(got[2].snippet) <= 240


def test_ledger_folds(spark):
    rows = [(s, i, i * 7, 1, i % 5 == 0, f"h{i}") for s in (1, 2) for i in range(1, 40)]
    table = spark.createDataFrame(rows, "source_id long, seq long, object_id long, generation long, deleted boolean, image_hash string").repartition(5)
    state, want = ledger.GENESIS, {}
    for _, seq, obj, gen, deleted, image in sorted(r for r in rows if r[0] == 1):
        state = hashlib.sha256(f"{state}|{obj}|{gen}|{'deleted' if deleted else image}".encode()).hexdigest()
        want[seq] = state
    assert {(r.source_id, r.seq): r.chain for r in ledger.chained(table).collect()} == {(s, n): c for s in (1, 2) for n, c in want.items()}
    assert ledger.chain_of(ledger.chain(table.where("source_id = 1"), 10)) == ledger.chain_of(ledger.chain(table.where("source_id = 2"), 10)) != ledger.chain_of(ledger.chain(table.where("source_id = 2 and seq > 1"), 10))
    assert ledger.leaf_bits(10) == 10 and ledger.leaf_bits(64 * 5000) == 13 and ledger.leaf_bits(10**12) == 20


def test_ranked(spark, monkeypatch):
    monkeypatch.setattr(ledger, "RANK_ROWS", 50)
    rows = spark.range(700).select((F.col("id") % 3).alias("source_id"), (F.col("id") * 7919 % 1009).alias("object_id"))
    got = sorted((r.source_id, r.object_id, r.seq) for r in ledger.minted(rows, 10).collect())
    for source in range(3):
        mine = [x for x in got if x[0] == source]
        assert [x[2] for x in mine] == list(range(11, 11 + len(mine)))


def test_hello():
    have = ledger.Position(2, 10, "h")
    assert ledger.admit_hello(have, 2, 12)[0] == "incremental" and ledger.admit_hello(have, 2, 9)[0] == "reject_rewound"
    what, waiting = ledger.admit_hello(have, 3, 5)
    assert what == "full_resync" and ledger.admit_hello(waiting, 4, 5)[0] == "reject_epoch" and ledger.admit(waiting, 2, 10, "h", 12) == "full_resync_required"
    after = ledger.resynced(waiting, 3, 5, "k")
    assert (after.epoch, after.seq, after.pending) == (3, 5, None) and ledger.admit_hello(after, 2, 50)[0] == "reject_epoch"


def test_watch(spark):
    records = spark.range(100).withColumnRenamed("id", "usn")
    journal = watch.Journal(5, 20, 80)
    assert [watch.read_journal(records, journal, *x)[0] for x in ((4, 30), (5, 10), (5, 80), (5, 30))] == ["identity_changed", "overflow", "empty", "records"]
    assert watch.read_journal(records, journal, 5, 30)[1].count() == 50
    events = spark.createDataFrame([("a", True, False), ("b/x", False, False), ("gone", False, False)], "path string, must_scan_below boolean, dropped boolean")
    entries = spark.createDataFrame([("a", 1), ("a/old", 1), ("a/same", 1), ("b/x", 1), ("b/y", 1), ("gone", 1), ("ab", 1)], "path string, modified long")
    listing = spark.createDataFrame([("a", 1), ("a/new", 1), ("a/same", 1), ("b/x", 2), ("b/y", 9), ("ab", 7)], "path string, modified long")
    what, changes = watch.path_events(events, entries, listing)
    assert what == "changes" and {(r.op, r.path) for r in changes.collect()} == {("delete", "a/old"), ("link", "a/new"), ("update", "b/x"), ("delete", "gone")}
    assert watch.path_events(events.withColumn("dropped", F.lit(True)), entries, listing)[0] == "rescan"
    done = watch.Overlap(4).enumerated(True).replayed("records", 9).published()
    assert (done.step, done.checkpoint, done.degraded) == ("published", 9, False)
    lost = watch.Overlap(4).enumerated(True).replayed("overflow", 9).published()
    assert (lost.step, lost.checkpoint, lost.degraded) == ("published", None, True) and watch.Overlap(4).enumerated(False).published().step == "aborted"


def test_documents(spark):
    hits = spark.range(5).select(F.col("id").alias("object_id"), F.col("id").alias("entry_id"), F.lit('n"').alias("name"))
    whole = json.loads("".join(export.json_document(hits, "*", 3)))
    assert whole["rows_exported"] == 3 and whole["truncated"] and [r["object_id"] for r in whole["rows"]] == ["0", "1", "2"]
    lines = list(export.csv_document(hits, bom=True))
    assert lines[0].startswith("\ufeffobject_id,entry_id,source,kind") and all(x.endswith("\r\n") for x in lines) and len(lines) == 6
    last = json.loads(list(export.ndjson(hits, "*", 5))[-1])
    assert (last["rows_exported"], last["truncated"], last["type"]) == (5, False, "summary")


def test_changes(spark):
    old = spark.createDataFrame([(i, 1, 5, 8, 0, 1, 1, "indexed") for i in range(6)], "object_id long, generation long, size long, allocated long, attributes long, created long, modified long, content_state string")
    new = spark.createDataFrame([(0, "file", 5, 8, 0, 1, 1, "pending"), (1, "file", 6, 8, 0, 1, 1, "pending"), (2, "file", 5, 9, 0, 1, 1, "pending"), (3, "directory", 6, 8, 0, 1, 2, "pending"), (4, "file", 5, 8, 0, 1, 1, "excluded"), (9, "file", 1, 1, 0, 1, 1, "pending")],
                                "object_id long, kind string, size long, allocated long, attributes long, created long, modified long, becomes string")
    got = {r.object_id: (r.generation, r.row_changed) for r in generation.changed(old, new).collect()}
    assert got == {0: (1, False), 1: (2, True), 2: (1, True), 3: (1, True), 4: (2, True), 9: (1, True)}
    assert [r.name for r in lookups.hosts_listed(spark.createDataFrame([(1, "Box", "AB12"), (2, "other", "cd")], "host_id long, name string, host_key string"), "box#ab12").collect()] == ["Box"]
