"""op10, op6, op3: groups of like documents against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import common, linking, minhash, sharding, spotsigs


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    ids, sets = [r[0] for r in rows], [sets_of(r[1]) for r in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {r[0]: len(s) for r, s in zip(rows, sets)}


@pytest.fixture(scope="module")
def crowd():
    """Near copies of one text (many not near each other), exact copies, documents with one passage in common, loners."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    base, passage = [word() for _ in range(160)], [word() for _ in range(60)]
    rows = []
    for i in range(110):
        text = list(base)
        for _ in range(rng.randrange(1, 9)):
            text[rng.randrange(160)] = word()
        rows.append((1000 + i, " ".join(text), "a"))
    rows += [(2000 + i, " ".join(base[:100]), "a") for i in range(30)]
    rows += [(3000 + i, " ".join([*(word() for _ in range(50)), *passage]), "b") for i in range(60)]
    rows += [(4000 + i, " ".join(word() for _ in range(rng.randrange(1, 80))), "c") for i in range(60)]
    return rows


def test_minhash(docs_of, crowd):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_of(crowd)).collect()}
    want, sizes = components(crowd)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = minhash.deduplicated(docs_of(crowd))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_minhash_rounds(docs_of, crowd, monkeypatch):
    """Repeated stars and many small blocks give the same."""
    monkeypatch.setattr(linking, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(crowd)).collect()}
    assert got == components(crowd)[0]


def test_minhash_odd(docs_of, odd):
    got = minhash.near_duplicates(docs_of(odd)).collect()
    assert len(got) == len(odd)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.component_id, r.n_shingles, r.kept))
    assert by[1] == [(1, 0, True)] and by[2] == [(2, 0, True)] and by[4] == [(4, 1, True)] * 2 and by[6][0][0] == 5 and not by[6][0][2]
    assert sorted(by[None], key=repr) == [(4, 1, False), (None, 0, True)]
    assert minhash.near_duplicates(docs_of([])).count() == 0
    assert minhash.deduplicated(docs_of(odd)).where("doc_id = 4").count() == 1


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables that operators write on their way."""
    from larkspur.llm import pii

    plans = []

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.durable(df, *args)

    for module in (linking, pii):
        monkeypatch.setattr(module, "durable", noted)
    return plans


def shuffles(plans):
    return sum(len(re.findall(r"\bExchange hashpartitioning", p)) for p in plans)


def test_components(spark, written):
    """Chains, hubs, negative ids, loops and repeated links; stars are left as they are, and a round takes few shuffles."""
    rng = random.Random(2)
    cases = [[], [(3, 3)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(60)], [(1000, 2000 + i) for i in range(30)] + [(i, 2000 + i) for i in range(30)]]
    cases += [[(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(90)]]
    for links in cases:
        want = {n: n for pair in links if pair[0] != pair[1] for n in pair}
        for _ in want:
            for a, b in links:
                want |= {n: min(want[a], want[b]) for n in (a, b) if a != b}
        got = linking.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert sorted(map(tuple, got)) == sorted(want.items())
    written.clear()
    stars = [(0, i) for i in range(1, 40)] + [(100, i) for i in range(101, 140)]
    linking.components(spark.createDataFrame(stars, "a long, b long"))
    assert len(written) == 2
    written.clear()
    linking.components(spark.createDataFrame([*stars, (39, 101)], "a long, b long"))
    assert shuffles(written) <= 10


def test_pii_shuffles(docs_of, written):
    """Tables of pii.find() take few shuffles: a round joins the graph with seeds and scores at once."""
    from larkspur.llm import pii

    pii.find(docs_of([(1, "mail a@b.co", "a")]))
    assert shuffles(written) <= 17


def test_trim(spark):
    """The driver's JVM gives back native memory, also when a table is written."""
    assert "rim native heap" in common.trim(spark)


def test_spotsigs(docs_of, odd):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "of", "der", "lorem", "ipsum", f"w{rng.randrange(99)}"]) for _ in range(rng.randrange(0, 90))), "a") for i in range(1, 300, 3)]
    rows += [(900, rows[5][1], "a")]
    for table in (rows, [r for r in odd if r[0] is not None and r[0] != 4]):
        got = {r.doc_id: r for r in spotsigs.compare_neighbours(docs_of(table)).collect()}
        ordered = sorted(table, key=lambda r: -r[0])
        words = spotsigs.Words()
        for at, (i, text, _) in enumerate(ordered):
            text, after = text or "", ordered[(at + 1) % len(ordered)][1] or ""
            k = len(text) // 3
            edited = text[: len(text) - k] + after[:k]
            r, own = got[i], words.fingerprint(text)
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert r.fingerprint == spotsigs.coded(own) and r.edited_fingerprint == spotsigs.coded(words.fingerprint(edited))
            assert r.near_edited == spotsigs.likeness(own, words.fingerprint(edited)) and r.near_next == spotsigs.likeness(own, words.fingerprint(after))
    assert spotsigs.compare_neighbours(docs_of(odd)).count() == len(odd) and spotsigs.compare_neighbours(docs_of([])).count() == 0


def test_spotsigs_ranges(docs_of, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_CHARS", 300)
    rows = [(i * 7 % 101, f"the word{i} number{i} of texts number {i}" * 3, "a") for i in range(101)]
    got = {r.doc_id: r.edited_sha256 for r in spotsigs.compare_neighbours(docs_of(rows)).collect()}
    text = {r[0]: r[1] for r in rows}
    for i in range(101):
        t, after = text[i], text[(i - 1) % 101]
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest()


def spot_sets(texts):
    """Signatures by a plain walk: an anchor and the two content words after it; all words if there are none."""
    out = []
    for text in texts:
        words = re.findall(rb"[a-z0-9_\x80-\xff]+", text.encode().lower())
        content = [(i, w) for i, w in enumerate(words) if w.decode("utf-8", "replace") not in spotsigs.ANCHORS]
        found = set()
        for i, w in enumerate(words):
            after = [c for j, c in content if j > i][:2]
            if w.decode("utf-8", "replace") in spotsigs.ANCHORS and len(after) == 2:
                found.add((w, *after))
        out.append(found or ({tuple(words)} if words else set()))
    return out


def plain_classes(ids, sets, least=0.75):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("small, block", [(2048, 1024), (2, 8)])
def test_spot_classes(docs_of, monkeypatch, small, block):
    """Likenesses and classes against plain sets: near copies, copies, chains of them, one passage in many texts, short texts."""
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "der", "la", f"w{rng.randrange(900)}", f"v{rng.randrange(900)}", f"u{rng.randrange(900)}"])
    base, passage = [word() for _ in range(200)], [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        text = list(base)
        for _ in range(rng.randrange(1, 14)):
            text[rng.randrange(200)] = word()
        texts.append(" ".join(text))
    texts += texts[:5] + [" ".join(base[:k]) for k in range(20, 200, 6)] + [" ".join([*passage, *(word() for _ in range(rng.randrange(60)))]) for _ in range(40)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["", "the", "of the", "lone words only", "lone words only"]
    ids = rng.sample(range(1000), len(texts))
    sets = spot_sets(texts)
    got = {r.doc_id: r for r in spotsigs.compared(docs_of([(i, t, "a") for i, t in zip(ids, texts)])).collect()}
    assert {i: r.class_id for i, r in got.items()} == plain_classes(ids, sets)
    order = sorted(range(len(ids)), key=lambda k: -ids[k])
    for at, k in enumerate(order):
        after = order[(at + 1) % len(order)]
        cut = len(texts[k]) // 3
        edited = spot_sets([texts[k][: len(texts[k]) - cut] + texts[after][:cut]])[0]
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert got[ids[k]].near_next == like(sets[k], sets[after]) and got[ids[k]].near_edited == like(sets[k], edited)


def test_spot_sketches():
    """Sketches rule out no pair that may be linked, and most others."""
    rng, kept, ruled = np.random.default_rng(4), 0, 0
    for n in (1, 2, 5, 20, 31, 33, 200, 3000):
        base = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        sets = [np.unique(np.concatenate([base[: n - k], rng.integers(0, 1 << 32, more, dtype=np.uint32)])) for k in range(0, n, max(1, n // 12)) for more in (0, n // 9, n // 3, n)]
        size, rows = np.array([len(s) for s in sets]), spotsigs.folded([spotsigs.sketch(s) for s in sets])
        for x in range(len(sets)):
            may = spotsigs.may_link(size, rows, x, 0.75)
            for y in range(len(sets)):
                near = spotsigs.likeness(sets[x], sets[y]) >= 0.75
                assert may[y] or not near
                kept, ruled = kept + bool(may[y] and not near), ruled + (not may[y])
    assert ruled > 5 * kept


def test_spot_sets_sent(docs_of, monkeypatch):
    """Texts are fingerprinted once for the classes; of texts that share signatures but are too unlike, blocks get no sets."""
    rng, calls, asked = random.Random(6), [], []
    fingerprinted, linked = spotsigs.fingerprinted, spotsigs._linked
    monkeypatch.setattr(spotsigs, "fingerprinted", lambda docs: calls.append(1) or fingerprinted(docs))
    monkeypatch.setattr(spotsigs, "_linked", lambda blocks, least: asked.append(blocks.count()) or linked(blocks, least))
    word = lambda: rng.choice(["the", f"w{rng.randrange(10**6)}", f"v{rng.randrange(10**6)}"])
    rows = []
    for g in range(8):
        passage = [word() for _ in range(800)]
        rows += [(10 * g + i, " ".join([*passage, *(word() for _ in range(240))]), "a") for i in range(5)]
    assert all(r.class_id == r.doc_id for r in spotsigs.classes(docs_of(rows)).collect())
    assert len(calls) == 1 and asked == [0]


def test_spot_classes_odd(docs_of, odd):
    got = sorted(((r.doc_id, r.class_id) for r in spotsigs.compared(docs_of(odd)).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (None, 4), (None, None), (5, 5), (6, 5), (7, 7), (8, 8)], key=repr)
    assert spotsigs.compared(docs_of([])).count() == 0


def test_sharding(docs_of, odd):
    rows = [(i, f"text {i % 40 if i < 100 else i}" if not 100 <= i < 700 else "hot", "a") for i in range(2000)]
    out = sharding.shard_documents(docs_of(rows), 8).join(docs_of(rows).select("doc_id", "text"), "doc_id").collect()
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for shard in sizes:
        assert sorted(r.slot for r in out if r["shard"] == shard) == list(range(sizes[shard]))
    homes = defaultdict(set)
    for r in out:
        homes[r.text].add(r["shard"])
    assert len(homes["hot"]) == 3 and all(len(s) == 1 for t, s in homes.items() if t != "hot")
    for table in (odd, []):
        out = sharding.shard_documents(docs_of(table)).collect()
        assert len(out) == len(table) and all(r.slot == 0 for r in out)
    null = next(r for r in sharding.shard_documents(docs_of(odd)).collect() if r.doc_id == 1)
    assert (null["size"], null.text_crc32) == (16, 0)


def test_sharding_rounds_share_code(spark):
    """A round's number is in one line of its plan, so later stages are compiled once for all rounds."""
    cells = spark.createDataFrame([(bytes([i % 7]), 0, i % 4, 5, 60, 1) for i in range(40)], "link binary, lane int, shard int, n long, group_n long, lanes int")
    plans = [re.sub(r"#\d+L?", "", sharding._round(cells, 60, 4, n)._jdf.queryExecution().optimizedPlan().toString()).splitlines() for n in (3, 8)]
    differ = [a for a, b in zip(*plans) if a != b]
    assert len(plans[0]) == len(plans[1]) and differ and all("AS turn" in line for line in differ)


def test_sharding_many_rows(spark):
    """A group of a quarter of many rows gets whole, and small groups do too, however many lots admission has."""
    key = F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < 3, F.lit("hot")).when(F.col("id") % 5 == 0, F.concat(F.lit("g"), F.floor(F.col("id") / 20).cast("string"))).otherwise(F.col("id").cast("string"))
    rows = spark.range(240_000).select(F.col("id").alias("doc_id"), F.unhex(F.md5(key.cast("binary"))).alias("link")).withColumn("row", F.xxhash64("doc_id", "link"))
    out = sharding.durable(sharding.shard(rows, 4))
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 240_000 and max(sizes) - min(sizes) <= 1
    cut = out.groupBy("link").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("homes")).where(F.col("homes") > F.ceil(F.col("n") / 60_000))
    assert cut.count() == 0


def test_native(docs_of, odd):
    """The kinds that must stay in the JVM run no Python: neither in what they return nor in the tables they write on the way."""
    from larkspur.llm import common, pii

    def plans(df):
        return df._jdf.queryExecution().executedPlan().toString()

    seen, write = [], common.durable

    def noted(df):
        seen.append(plans(df))
        return write(df)

    for module, run in ((pii, pii.redact), (sharding, sharding.shard_documents)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(module, "durable", noted)
            seen.append(plans(run(docs_of(odd))))
    assert len(seen) > 10 and not any(re.search(r"Python|Pandas|Arrow|ExternalRDD|MapPartitions", p) for p in seen)
