"""SpotSigs: chains of content words after common-word anchors.

A signature is an anchor and the CHAIN content words that follow it (anchors in between are skipped);
a fingerprint is the set of a text's signatures, as 32-bit hashes. A text without an anchor chain has
one signature of all its words. Likeness is the Jaccard coefficient; sets whose sizes alone keep it
below a bound are not compared.

compare_neighbours() walks the documents in descending order of doc_id: id ranges (by approximate
percentiles) are sorted in their tasks, and the last rows of a range also go to the range below it,
whose first document they need. So each text is sent once, and tasks stream.

classes() groups documents whose fingerprints have a likeness of LEAST or more, also through others: distinct
fingerprints are dealt to partitions of set length, whose bounds are powers of 1 / LEAST, and to the next shorter one. In a
partition, sets meet in the cells of the signatures of their prefix, rarest first (by counts of SLOTS hash slots, a table of
fixed size), so signatures that many documents share hardly make cells. Where sets meet, sizes and sketches rule pairs out before they are
compared, and sets are sent only for nodes with a pair that is left; pairs that links already connect are not compared. A sketch has a bit for each
of some hash values, set if an odd number of signatures has it, so sketches differ in at most as many bits as sets in signatures: no link is lost.

Scale: a range has about RANGE_CHARS of text up to MOST_RANGES ranges, 260 GB of text; beyond, a task's range grows
(3 GB at 100 TB) and its sort spills.

Defined results: a null text counts as empty; the empty text and a text without words have an empty set; two
empty sets have likeness 1, an empty and another 0; empty sets are in no class but their own; equal ids are in order of text; null ids come last; a
single document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import durable, each, mix64, scratch
from larkspur.llm.linking import Forest, blocked, linked_in_cells

#: Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was we were which will with you "
    "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für ich im ist mit nach nicht sich sie sind und von war wie wir zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qui que sa se ses son sur un une vous "
    "al como con del el ella ellos entre esta este ha los las más no nos para pero por se sin sobre su sus también una uno y ya".split()
)
CHAIN = 2
RANGE_CHARS = 8_000_000
#: Ranges get larger beyond so many; their bounds are part of the plan.
MOST_RANGES = 32_768
#: Fingerprints of this likeness are of one class.
LEAST = 0.75
#: Counters by which signatures are ordered.
SLOTS = 16_384
#: Fingerprints of a block's side, at most, and their bytes, about.
BLOCK, BLOCK_BYTES = 1024, 8_000_000
#: Rows of an Arrow batch that is put out, about.
ROWS = 10_000
#: Bytes of tokens (letters in lower case, digits, underscores and all beyond ASCII); others become blanks.
_LOWER = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in bytes(range(256)).lower())


def _tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Words:
    """Tokens -> 64-bit hashes whose lowest bit marks an anchor; hashes -> signatures."""

    anchors = np.sort(np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in ANCHORS], np.uint64))

    def hashes(self, text: str) -> np.ndarray:
        tokens = _tokens(text)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
        at = np.minimum(np.searchsorted(self.anchors, h), len(self.anchors) - 1)
        return h & ~np.uint64(1) | (self.anchors[at] == h)

    def chains(self, h: np.ndarray) -> np.ndarray | None:
        """Sorted distinct signatures of these hashes; None if no anchor has a chain."""
        anchor = (h & np.uint64(1)).astype(bool)
        content, at = h[~anchor], np.cumsum(~anchor)[anchor]
        fits = at + CHAIN <= len(content)
        value, at = h[anchor][fits], at[fits]
        if not len(at):
            return None
        with np.errstate(over="ignore"):
            for i in range(CHAIN):
                value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + content[at + i])
        return np.unique((value >> np.uint64(32)).astype("<u4"))

    def whole(self, text: str) -> np.ndarray:
        """The signature of all words, if there are any."""
        tokens = _tokens(text)
        value = np.frombuffer(hashlib.blake2b(b" ".join(tokens), digest_size=8).digest(), np.uint64) if tokens else np.zeros(0, np.uint64)
        return (value >> np.uint64(32)).astype("<u4")

    def fingerprint(self, text: str, h: np.ndarray | None = None) -> np.ndarray:
        """Sorted distinct signatures; h: the text's hashes, if they are known."""
        found = self.chains(self.hashes(text) if h is None else h)
        return self.whole(text) if found is None else found


class Cut:
    """A text with its hashes, and how many of them are of the text up to the last blank before each of some places."""

    def __init__(self, words: Words, text: str, places: Iterable[int]):
        self.words, self.text = words, text
        self.blank = {p: text.rfind(" ", 0, p) + 1 for p in places}
        parts = [words.hashes(text[a:b]) for a, b in pairwise([*sorted({0, *self.blank.values()}), len(text)])]
        self.hashes = np.concatenate(parts) if len(parts) > 1 else parts[0]
        self.n = dict(zip(sorted({0, *self.blank.values()}), np.cumsum([0, *map(len, parts)])))

    def head(self, place: int) -> tuple[int, np.ndarray]:
        """Where the last word before a place begins, and the hashes before that."""
        return self.blank[place], self.hashes[: self.n[self.blank[place]]]


def edited(before: Cut, after: Cut) -> tuple[str, np.ndarray]:
    """The text before with its end replaced by the beginning of the one after, and its fingerprint; only words at the seams are hashed again."""
    k = len(before.text) // 3
    cut = len(before.text) - k
    changed = before.text[:cut] + after.text[:k]
    begin, head = before.head(cut)
    end, tail = after.head(k)
    if end:
        first = after.text.find(" ") + 1
        skipped = len(_tokens(after.text[:first]))
        parts = [head, before.words.hashes(before.text[begin:cut] + after.text[:first]), tail[skipped:], before.words.hashes(after.text[end:k])]
    else:
        parts = [head, before.words.hashes(changed[begin:])]
    return changed, before.words.fingerprint(changed, np.concatenate(parts))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard coefficient of two sorted sets; 0 without comparing if sizes keep it below least."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def coded(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.tobytes()).decode()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint (array of signatures as unsigned 32-bit numbers, sorted)."""

    def run(batches):
        words = Words()
        for batch in batches:
            found = [words.fingerprint(t or "").astype("i8") for t in each(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint array<long>")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key, by two levels of about the root of their number."""
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not parts:
        return F.lit(0)
    long = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    outer = F.size(F.filter(long([p[0] for p in parts]), lambda b: b <= key))
    inner = F.size(F.filter(F.element_at(F.array(*map(long, parts)), F.greatest(outer, F.lit(1))), lambda b: b <= key))
    return F.when(key.isNull() | (outer == 0), 0).otherwise((outer - 1) * step + inner)


def _key(spots: bytes) -> int:
    """64 bits that stand for a fingerprint among those of one doc_id."""
    return int.from_bytes(hashlib.blake2b(spots, digest_size=8).digest(), "little", signed=True)


def compare_neighbours(docs: DataFrame, classed: DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, fingerprints and likenesses of each text, its edited text and the next document's. classed: (doc_id, key, class_id) of
    documents whose class is not their own; its narrow rows are dealt and sorted with the texts, just before theirs, which gives class_id without a join of texts."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low, high, chars = docs.agg(F.min("doc_id"), F.max("doc_id"), F.sum(F.length("text"))).first()
    ranges = min(MOST_RANGES, max(1, math.ceil((chars or 0) / RANGE_CHARS)))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 4 * ranges)).first()[0] if ranges > 1 else None
    bounds = sorted({b for b in bounds or [] if b > low})
    placed = docs.withColumn("range", _range_of(F.col("doc_id"), bounds))
    # a bound is the id that ends its range: it also goes to the range below, before that one's own; the first document of all ends the last range
    own, carried, first = (F.struct(r.cast("int").alias("range"), F.lit(part).alias("part")) for r, part in ((F.col("range"), 1), (F.col("range") - 1, 0), (F.lit(0), 2)))
    lowest = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.greatest(F.col("range"), F.lit(1))) if bounds else F.lit(None).cast("long")
    places = F.array(own, F.when((F.col("range") > 0) & (F.col("doc_id") == lowest), carried), F.when(F.col("doc_id").eqNullSafe(F.lit(high).cast("long")), first))
    none = F.lit(None).cast("long")
    placed = placed.withColumn("to", F.explode(F.filter(places, lambda p: p.isNotNull()))).select("doc_id", "text", "to.range", "to.part", none.alias("key"), none.alias("class_id"))
    if classed is not None:
        marks = classed.withColumn("range", _range_of(F.col("doc_id"), bounds).cast("int"))
        lower = marks.where((F.col("range") > 0) & (F.col("doc_id") == lowest)).withColumn("range", F.col("range") - 1)
        marks = marks.withColumn("part", F.lit(1)).unionByName(lower.withColumn("part", F.lit(0)))
        placed = placed.unionByName(marks.select("doc_id", F.lit(None).cast("string").alias("text"), "range", "part", "key", "class_id"))
    # marks have no text, so they stand before the texts of their id
    placed = placed.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "part", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches):
        words, waiting, here, marks = Words(), None, None, {}
        for batch in batches:
            out = []
            for range_, part, doc_id, text, key, class_id in zip(*(each(batch.column(c)) for c in ("range", "part", "doc_id", "text", "key", "class_id"))):
                if range_ != here:  # what still waits is carried to the range below
                    here, waiting = range_, None
                if text is None:
                    marks = {doc_id: {**marks.get(doc_id, {}), key: class_id}}
                    continue
                if part == 2 and waiting is None:
                    continue
                whole = Cut(words, text, [len(text) - len(text) // 3, *([len(waiting[1].text) // 3] if waiting else [])])
                own = words.fingerprint(text, whole.hashes)
                if part and waiting is not None:
                    before_id, before, fp, class_ = waiting
                    changed, spots = edited(before, whole)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before_id, len(before.text), digest, coded(fp), coded(spots), likeness(fp, spots), likeness(fp, own), class_))
                waiting = None if part == 2 else (doc_id, whole, own, marks[doc_id].get(_key(own.tobytes()), doc_id) if doc_id in marks else doc_id)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], columns)

    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long")


def _slot(spots: np.ndarray) -> np.ndarray:
    return (spots % np.uint32(SLOTS)).astype(np.int64)


def _cells(sets: DataFrame, counted: DataFrame, least: float) -> DataFrame:
    """(cell, node): the signatures of each set's prefix, in the partition of its length and in the next shorter one; counted: rows whose signatures set their order."""

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for data in each(batch.column("spots")):
                total += np.bincount(_slot(np.frombuffer(data, "<u4")), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    # at most SLOTS rows
    counts = counted.select("spots").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    often = np.zeros(SLOTS, np.int64)
    for row in counts:
        often[row.slot] = row.n
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        for batch in batches:
            node, cell = [], []
            for n, data in zip(batch.column("node").to_pylist(), each(batch.column("spots"))):
                spots = np.frombuffer(data, "<u4")
                order = np.lexsort((spots, shared.value[_slot(spots)]))
                prefix = spots[order[: len(spots) - math.ceil(len(spots) * least - 1e-9) + 1]].astype(np.uint64)
                part = int(math.log(len(spots)) / math.log(1 / least) + 1e-9)
                for p in (part, part - 1):
                    cell.append(mix64(prefix | np.uint64((p + 1) << 32)))
                    node.append(np.full(len(prefix), n))
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell).view("i8")), pa.array(np.concatenate(node))], ["cell", "node"])

    return sets.select("node", "spots").mapInArrow(run, "cell long, node long")


def sketch(spots: np.ndarray) -> bytes:
    """Parities of the counts of two to four times as many hash values as there are signatures (64 at least), a power of two."""
    width = max(64, 1 << (2 * len(spots) - 1).bit_length())
    return np.packbits((np.bincount(spots & np.uint32(width - 1), minlength=width) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one width, the smallest, as rows of 64-bit numbers."""
    width = min(map(len, sketches))
    same = [x if len(x) == width else np.bitwise_xor.reduce(np.frombuffer(x, "u1").reshape(-1, width)).tobytes() for x in sketches]
    return np.frombuffer(b"".join(same), "<u8").reshape(len(same), -1)


def may_link(size: np.ndarray, rows: np.ndarray, x: int, least: float) -> np.ndarray:
    """Which sets may have a likeness of least to the x-th: by sizes, and as sketches differ in no more bits than sets in signatures."""
    fits = (size >= size[x] * least) & (size[x] >= size * least)
    return fits & (np.bitwise_count(rows ^ rows[x]).sum(1, dtype=np.int64) <= (size + size[x]) * ((1 - least) / (1 + least)) + 1e-9)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, spots (the fingerprint's bytes), their number n, sketch, key of documents with words."""

    def run(batches):
        words = Words()
        for batch in batches:
            found = [words.fingerprint(t or "") for t in each(batch.column("text"))]
            full = pa.array([bool(len(x)) for x in found], pa.bool_())
            ids, found = batch.column("doc_id").filter(full), [x for x in found if len(x)]
            spots = [x.tobytes() for x in found]
            columns = [ids, pa.array(spots, pa.binary()), pa.array(map(len, found), pa.int64()), pa.array(map(sketch, found), pa.binary()), pa.array(map(_key, spots), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spots", "n", "sketch", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spots binary, n long, sketch binary, key long")


_BLOCK = ["cell", "i", "j"]


def _together(rows: DataFrame) -> DataFrame:
    """Rows of a block one after the other in one task."""
    return rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)


def _blocks(batches: Iterable[pa.RecordBatch], numbers: list[str], data: str) -> Iterator[tuple[tuple, list[np.ndarray], list[bytes]]]:
    """(cell, i, j), columns of numbers and the column of bytes of each block."""
    held, values, last = [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _BLOCK])
        columns, texts = [batch.column(c).to_numpy() for c in numbers], batch.column(data).to_pylist()
        for a, b in pairwise([0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]):
            now = tuple(key[:, a].tolist())
            if held and now != last:
                yield last, [np.concatenate(x) for x in zip(*held)], values
                held, values = [], []
            held.append([c[a:b] for c in columns])
            values, last = values + texts[a:b], now
    if held:
        yield last, [np.concatenate(x) for x in zip(*held)], values


def _put(found: Iterable[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns of blocks as batches of about ROWS."""
    held, n = [], 0
    for columns in found:
        held.append(columns)
        n += len(columns[0])
        if n >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)


def _pairs_of(i: int, j: int, node: np.ndarray, comp: np.ndarray, mine: np.ndarray, x: int) -> np.ndarray:
    """With which nodes the x-th makes a pair of this block."""
    return (comp != comp[x]) & (node > node[x] if i == j else mine == j)


def _agreeing(rest: DataFrame, least: float) -> DataFrame:
    """The rows (cell, i, j, mine, node, comp) of blocks (..., n, sketch) whose sizes and sketches allow a link with another."""
    names = ["cell", "i", "j", "mine", "node", "comp"]

    def found(batches):
        for (cell, i, j), (mine, node, comp, size), sketches in _blocks(batches, ["mine", "node", "comp", "n"], "sketch"):
            rows, asked = folded(sketches), np.zeros(len(node), bool)
            for x in np.flatnonzero(mine == i):
                near = _pairs_of(i, j, node, comp, mine, x) & may_link(size, rows, x, least)
                if near.any():
                    asked |= near
                    asked[x] = True
            if asked.any():
                yield [np.full(asked.sum(), cell), *(np.full(asked.sum(), v, np.int32) for v in (i, j)), mine[asked], node[asked], comp[asked]]

    return _together(rest.select(*names, "n", "sketch")).mapInArrow(lambda batches: _put(found(batches), names), "cell long, i int, j int, mine int, node long, comp long")


def _linked(blocks: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect all that is linked among the nodes of different components in blocks (cell, i, j, mine, node, comp, spots)."""

    def found(batches):
        for (_, i, j), (mine, node, comp), spots in _blocks(batches, ["mine", "node", "comp"], "spots"):
            size = np.array([len(x) // 4 for x in spots])
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            values, place = np.unique(np.frombuffer(b"".join(spots), "<u4"), return_inverse=True)
            mark, forest, links = np.zeros(len(values), bool), Forest(), []
            for x in np.flatnonzero(mine == i):
                mine_ = place[starts[x] : starts[x] + size[x]]
                mark[mine_] = True
                both = np.add.reduceat(mark[place], starts, dtype=np.int64)
                mark[mine_] = False
                near = _pairs_of(i, j, node, comp, mine, x) & (both >= least * (size + size[x] - both) - 1e-9)
                for y in np.flatnonzero(near):
                    a, b = int(node[x]), int(node[y])
                    if forest.top(a) != forest.top(b):
                        forest.join(a, b)
                        links.append((min(a, b), max(a, b)))
            if links:
                yield list(np.array(links, np.int64).T)

    return _together(blocks).mapInArrow(lambda batches: _put(found(batches), ["a", "b"]), "a long, b long")


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, key, class_id of documents with words: the smallest doc_id that links of at least this likeness connect with it."""
    rows = durable(fingerprinted(docs).withColumn("node", F.monotonically_increasing_id()))
    # one of equal fingerprints is a node
    sets = durable(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("node").alias("node"), F.count("*").alias("m")))
    copies = rows.select("key", F.col("node").alias("copy")).join(sets.where("m > 1").select("key", "node"), "key").where("copy <> node").select(F.col("copy").alias("node"))
    every = _cells(rows.select("node", "spots").join(copies, "node", "left_anti"), rows, least)
    cells = every.withColumn("m", F.count("*").over(Window.partitionBy("cell"))).where("m > 1").select("cell", "node")

    def confirm(pairs: DataFrame) -> DataFrame:
        for c in "ab":
            pairs = pairs.join(rows.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)
        pairs = pairs.where((F.col("n_a") >= F.col("n_b") * least) & (F.col("n_b") >= F.col("n_a") * least))

        def alike(batches):
            for batch in batches:
                sizes = zip(*(batch.column(f"n_{c}").to_pylist() for c in "ab"))
                both = zip(*(each(batch.column(f"sketch_{c}")) for c in "ab"))
                near = [bool(may_link(np.array(n), folded(list(s)), 0, least)[1]) for n, s in zip(sizes, both)]
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near, pa.bool_())) for c in "ab"], ["a", "b"])

        pairs = durable(pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(alike, "a long, b long"))
        for c in "ab":
            pairs = pairs.join(rows.select(F.col("node").alias(c), F.col("spots").alias(f"spots_{c}")), c)

        def run(batches):
            for batch in batches:
                near = [likeness(*(np.frombuffer(x, "<u4") for x in both), least) >= least for both in zip(each(batch.column("spots_a")), each(batch.column("spots_b")))]
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near, pa.bool_())) for c in ("a", "b")], ["a", "b"])

        return pairs.select("a", "b", "spots_a", "spots_b").mapInArrow(run, "a long, b long")

    def across(rest: DataFrame) -> DataFrame:
        rest = rest.join(rows.select("node", "n", "sketch"), "node").withColumn("bytes", F.col("n") * 4)
        near = durable(_agreeing(blocked(rest, "bytes", BLOCK, BLOCK_BYTES), least))
        return _linked(near.join(rows.select("node", "spots"), "node"), least)

    comps = linked_in_cells(cells, confirm, across)
    grouped = sets.join(comps, "node", "left").select("key", "rep", "m", F.col("comp").isNotNull().alias("linked"), F.coalesce("comp", "node").alias("comp"))
    lowest = grouped.groupBy("comp").agg(F.min("rep").alias("class_id"))
    # of most fingerprints there is one, without links
    shared = grouped.where("linked or m > 1").join(lowest, "comp").select("key", "class_id")
    return rows.select("doc_id", "key").join(shared, "key").distinct()


def compared(docs: DataFrame) -> DataFrame:
    """compare_neighbours() with class_id: the smallest doc_id of the document's class (its own if its set is empty)."""
    with scratch(docs.sparkSession):
        known = durable(classes(docs).where(~F.col("class_id").eqNullSafe(F.col("doc_id"))), kept=True)
    return compare_neighbours(docs, known)
