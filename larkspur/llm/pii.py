"""Personal data by bootstrapped contextual extraction. DataFrame functions only.

1. Base spans: four kinds by regular expression and checks (see KINDS). They and the strict form of secrets
   (SECRET: a run of 40 lower-case hexadecimal digits) are the seeds.
2. Seeds induce lexical patterns, of four types for each occurrence: the word before, the two words before,
   the word after, the words on both sides (lower case, digits as 0; of long words the WORD_CHARS characters next to the span). Other identifier-like tokens (four digits or
   more, six characters or more, without punctuation around them) are unknown instances with patterns of their own.
3. Spark scores the graph of patterns and instances: a pattern's confidence in a kind is the score of
   its distinct instances over their number plus one; only patterns of SUPPORT seeds or more and a confidence of
   PATTERN_LEAST or more count. An instance's score is the noisy-or of its patterns' confidences; seeds stay at 1. ROUNDS times;
   instances scored CONFIDENT or more are seeds of the next rounds, so their contexts become patterns too.
4. Unknown tokens of instances that were so accepted become spans of that kind, wherever they stand, in
   addition to the base spans and seeds; so do unknown tokens that equal a seed where its own form can't match.

The regular expressions are guarded so that long runs cost linear time: a run that can't match
from its start can't match from within, so a match starts at a run's start or where the last one ended. No
group is repeated with captures or by backtracking, so long matches need no stack. Texts are scanned in pieces of
PIECE characters or more, cut only where no match of any kind can go on, so a long text with many spans costs time in proportion to its
length, and spans are the same as without pieces.

Scale: one scan of the texts; only spans and contexts go on. Distinct pairs of pattern and instance are joined,
so a frequent context sends one row for each distinct instance; joins on a frequent pattern or value have one row
for each key on their other side and are split by adaptive skew joins.

Defined results: a null text counts as empty; no spans give an empty string; offsets are code points,
end exclusive; repeated rows get equal results; rows with a null doc_id are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import durable, packed, unpacked

ROUNDS = 3
CONFIDENT = 0.6
SUPPORT = 3
PATTERN_LEAST = 0.5
#: Characters of a piece, at least. It ends before white space across which no card or phone number can go on: these have just spaces inside,
#: and digits, hyphens, dots and parentheses on both sides of them.
PIECE = 1000
_PIECES = r"(?s)(?:.{%d}.*?(?:[^0-9 ().+\-](?=\s)|.(?=[\t\n\r\f\x0B])|.(?= ++[^0-9 ().\-]))|.+)" % PIECE
#: Characters of blocks in which contexts are looked for: that of the span, two before, one after.
BLOCK = 500
_BLOCKS = r"(?s).{1,%d}" % BLOCK
#: Characters of a word next to a span that tell patterns apart.
WORD_CHARS = 64
#: In the reversed text before a span, and in the text after it: marks, the next word and the one after that.
_NEXT = r"^[^\s\p{L}\p{N}]*+\s++(\S{1,%d}+)(?:\S*+\s++(\S{1,%d}+))?" % (WORD_CHARS, WORD_CHARS)

#: kind -> pattern (guarded), quick test of the text, in the order in which kinds are listed.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]+\."),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9]){12,}+", r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]"),
}
#: The strict form of a secret.
SECRET = (r"(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])", r"[0-9a-f]{40}")
#: Characters that don't belong to a token when they stand at its ends.
MARKS = "\"'`([{<>}])#*!?,;:.$%&=|~"
#: An identifier-like token, but for those of the form of an address.
UNKNOWN = (r"(?<!\S)(?!(?:[0-9]++\.){3}[0-9]++(?!\S))(?=\S{6})(?=(?:[^\s0-9]*+[0-9]){4})\S++", r"[0-9]\S*[0-9]\S*[0-9]")
_SPAN = "array<struct<start:int,stop:int,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value taken once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(lengths: Column) -> Column:
    """Sums of what stands before each element of an array of int, in blocks, so that no step copies much."""
    size = 64

    def plain(part: Column, at: Column) -> Column:
        begin = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, begin, lambda state, x: F.struct((state["at"] + x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out")), lambda state: state["out"])

    def blocks(all_: Column) -> Column:
        # of an empty array the parts are empty too
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda b: F.slice(all_, b * size + 1, F.lit(size)))

        def summed(parts: Column) -> Column:
            offsets = plain(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda x, y: x + y)), F.lit(0))
            return F.flatten(F.zip_with(parts, offsets, plain))

        return _let(parts, summed)

    return _let(lengths, blocks)


def _found(text: Column, pattern: str, quick: str) -> Column:
    """Matches with offsets: what lies between them is what split() leaves."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # one gap more than matches
    zipped = F.filter(F.zip_with(matches, gaps, lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m"))), lambda x: x["m"].isNotNull())

    def placed(all_: Column) -> Column:
        starts = _before(F.transform(all_, lambda x: x["g"] + x["n"]))
        return F.zip_with(all_, starts, lambda x, at: F.struct((at + x["g"]).alias("start"), (at + x["g"] + x["n"]).alias("stop"), x["m"].alias("value")))

    return F.when(text.rlike(quick), _let(zipped, placed)).otherwise(F.array().cast(_SPAN))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _of_kind(spans: Column, kind: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(kind.alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value")))


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.when((F.length(digits) >= 13) & (F.length(digits) <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return (F.length(digits) >= 9) & (F.length(digits) <= 15)
    return F.lit(True)


def _trimmed(span: Column) -> Column:
    """An unknown token without the marks at its ends."""
    left = F.ltrim(span["value"], F.lit(MARKS))
    core = F.rtrim(left, F.lit(MARKS))
    start = span["start"] + F.length(span["value"]) - F.length(left)
    return F.struct(start.alias("start"), (start + F.length(core)).alias("stop"), core.alias("value"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row, spans (kind, start, stop, value, before, earlier, after; kind null: unknown) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def bases(piece: Column) -> Column:
        """A piece with its base spans and other tokens."""
        base = F.concat(*(_of_kind(F.filter(_found(piece, *KINDS[k]), partial(_valid, k)), F.lit(k)) for k in KINDS), _of_kind(_found(piece, *SECRET), F.lit("secret")))
        unknown = _of_kind(F.transform(_found(piece, *UNKNOWN), _trimmed), F.lit(None).cast("string"))
        return F.struct(base.alias("base"), unknown.alias("unknown"))

    def described(x: Column, blocks: Column) -> Column:
        block = lambda place, step=0: F.coalesce(F.get(blocks, F.floor(place / BLOCK).cast("int") + step), F.lit(""))
        back = F.reverse(F.concat(block(x["start"], -2), block(x["start"], -1), F.substring(block(x["start"]), F.lit(1), x["start"] % BLOCK)))
        forth = F.concat(F.substring(block(x["stop"]), x["stop"] % BLOCK + 1, F.lit(BLOCK)), block(x["stop"], 1))
        near = _let(back, lambda t: F.array(*(F.reverse(F.regexp_extract(t, _NEXT, i)) for i in (1, 2)), F.regexp_extract(forth, _NEXT, 1)))
        return F.struct(
            *(x[c].alias(c) for c in ("kind", "start", "stop")), F.lower(x["value"]).alias("value"),
            F.transform(near, lambda w: F.regexp_replace(F.lower(w), "[0-9]", "0")).alias("near"),
        )

    def spans(p: Column, at: Column) -> Column:
        clear = F.filter(p["unknown"], lambda u: (u["stop"] > u["start"]) & ~F.exists(p["base"], lambda b: (b["start"] < u["stop"]) & (u["start"] < b["stop"])))
        return F.transform(F.concat(p["base"], clear), lambda x: F.struct(x["kind"].alias("kind"), (at + x["start"]).alias("start"), (at + x["stop"]).alias("stop"), x["value"].alias("value")))

    def all_spans(cut: Column) -> Column:
        return F.flatten(F.zip_with(F.transform(cut, bases), _before(F.transform(cut, F.length)), spans))

    found = _let(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), all_spans)
    found = _let(F.regexp_extract_all(text, F.lit(_BLOCKS), F.lit(0)), lambda blocks: F.transform(found, lambda x: described(x, blocks)))
    fields = F.transform(found, lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "stop", "value")), *(s["near"][i].alias(c) for i, c in enumerate(("before", "earlier", "after")))))
    return docs.select("doc_id", F.xxhash64(text).alias("row"), fields.alias("spans"))


def _patterns() -> Column:
    """Lexical patterns of an occurrence: type and words."""
    before, earlier, after = F.col("before"), F.col("earlier"), F.col("after")
    # a mark that stands alone is no word
    word = before.rlike(r"[\p{L}\p{N}]")
    both = F.when(word & (after != ""), F.concat(F.lit("both "), before, F.lit(" "), after))
    words = F.when(earlier != "", F.concat(F.lit("two "), earlier, F.lit(" "), before))
    found = F.array(F.when(word, F.concat(F.lit("one "), before)), words, F.when(after != "", F.concat(F.lit("next "), after)), both)
    return F.filter(found, lambda p: p.isNotNull())


def discovered(found: DataFrame) -> DataFrame:
    """doc_id, row, kind, start, stop of unknown tokens that bootstrapping accepts."""
    seen = found.select("doc_id", "row", F.explode("spans").alias("s")).select("doc_id", "row", "s.*")
    pairs = seen.select(F.explode(_patterns()).alias("pattern"), "value", "kind")
    pairs = durable(pairs.distinct())
    # a pattern of fewer distinct instances can't get SUPPORT
    width = pairs.groupBy("pattern").agg(F.count_distinct("value").alias("instances")).where(F.col("instances") >= SUPPORT)
    graph = durable(pairs.join(width, "pattern").groupBy("pattern", "value").agg(F.first("instances").alias("instances")))
    labels = seeds = durable(seen.where("kind is not null").select("value", "kind").distinct())
    scores = None
    for number in range(ROUNDS):
        # a value is either accepted or scored; no pair of pattern, value and kind comes twice
        known = labels.withColumn("score", F.lit(None).cast("double"))
        if scores is not None:
            known = known.unionByName(scores.where(F.col("score") < CONFIDENT))
        # patterns that hold neither seeds nor accepted instances can't be reached
        support = graph.join(known, "value").groupBy("pattern", "kind").agg(F.count_if(F.col("score").isNull()).alias("seeds"), F.sum("score").alias("own"), F.first("instances").alias("instances"))
        gained = support.where(F.col("seeds") >= SUPPORT).withColumn("sum", F.col("seeds") + F.coalesce("own", F.lit(0.0)))
        patterns = gained.select("pattern", "kind", (F.col("sum") / (F.col("instances") + 1)).alias("confidence")).where(F.col("confidence") >= PATTERN_LEAST)
        asked = graph.join(labels.select("value").distinct(), "value", "left_anti")
        reached = asked.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence")))))).alias("score"))
        # an instance is of the kind that claims it most
        best = F.max(F.struct("score", "kind"))
        scores = durable(reached.groupBy("value").agg(best.alias("b")).select("value", "b.kind", "b.score"))
        accepted = labels.unionByName(scores.where(F.col("score") >= CONFIDENT).select("value", "kind"))
        labels = accepted if number == ROUNDS - 1 else durable(accepted)
    # a value that is a seed of several kinds is of the first by name
    good = labels.groupBy("value").agg(F.min("kind").alias("as"))
    return seen.where("kind is null").join(good, "value").select("doc_id", "row", F.col("as").alias("kind"), "start", "stop").distinct()


def find(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), base, added and spans (both): arrays of (kind, start, stop), by kind as listed (secrets last), then start.
    discovered is the number of spans that the graph of patterns has added."""
    found = durable(scanned(docs))
    order = F.array(*(F.lit(k) for k in [*KINDS, "secret"]))

    def listed(spans: Column) -> Column:
        keyed = F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("o"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    def of(spans: Column, test) -> Column:
        return F.transform(F.filter(spans, test), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    kept, secrets = of(F.col("spans"), lambda s: s["kind"].isin(*KINDS)), of(F.col("spans"), lambda s: s["kind"] == "secret")
    more = discovered(found).groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).agg(F.collect_set(F.struct("kind", "start", "stop")).alias("more"))
    rows = found.select("doc_id", "row", kept.alias("base"), secrets.alias("secrets"))
    rows = rows.join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    rows = rows.withColumn("more", F.coalesce("more", none)).withColumn("added", F.concat("secrets", "more"))
    spans = listed(F.concat("base", "added"))
    return rows.select("doc_id", "row", listed(F.col("base")).alias("base"), listed(F.col("added")).alias("added"), spans.alias("spans"), F.size("more").cast("long").alias("discovered"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; overlapping spans become one, named after the first."""
    found = find(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))).alias("_s")).dropDuplicates(["_d", "_r"])
    rows = packed(docs).withColumn("_k", F.xxhash64(F.coalesce("doc.text", F.lit(""))))
    rows = rows.join(found, F.col("doc.doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_r")), "left")
    text = F.col("doc.text")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(s["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], F.array(between, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return unpacked(rows.withColumn("doc", F.when(F.col("_s").isNull(), F.col("doc")).otherwise(F.col("doc").withField("text", F.aggregate("_s", begin, step, finish)))), docs)
