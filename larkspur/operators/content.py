"""Search in chunks of text: predicates, BM25, scores of files, snippets, previews."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import LONGEST_TOKEN, in_order_within, java_regex, phrase_key, query_tokens, tokens
from larkspur.plans import ast as q

MOST_MATCHES = 8
K1, B = 1.2, 0.75
SNIPPETS, SNIPPET_CHARS = 3, 240
_EDGE = r"[\p{IsAlphabetic}\p{N}]"


def chunk_predicate(n: q.Text, text: Column | None = None) -> Column:
    """A content clause over one chunk's text."""
    text = F.col("text") if text is None else text
    words = query_tokens(n.value)
    found = tokens(text, longest=LONGEST_TOKEN)
    if n.mode == "ranked":
        # a plain substring test is cheap and rules most chunks out before tokens are made
        return reduce(and_, [F.contains(F.lower(text), F.lit(w)) for w in words] + [F.array_contains(found, w) for w in words], F.lit(bool(words)))
    if n.mode in ("phrase", "proximity"):
        if not words:
            return F.lit(False)
        likely = reduce(and_, [F.contains(F.lower(text), F.lit(w)) for w in words])
        if n.mode == "phrase" or len(words) == 1:
            return likely & F.contains(phrase_key(found), F.lit(" " + " ".join(words) + " "))
        return likely & in_order_within(found, words, n.slop)
    if n.mode == "exact":
        literal = r"\Q" + n.value.replace(r"\E", r"\E\\E\Q") + r"\E"
        likely = F.contains(text, F.lit(n.value)) if n.case else F.contains(F.lower(text), F.lit(n.value.lower()))
        return likely & text.rlike(("" if n.case else "(?iu)") + f"(?<!{_EDGE}){literal}(?!{_EDGE})")
    if n.mode == "substring":
        return F.contains(text, F.lit(n.value)) if n.case else F.contains(F.lower(text), F.lit(n.value.lower()))
    from larkspur.plans.regexplan import likely_predicate

    pattern = java_regex(n.value, n.case)
    # a match of no characters doesn't count
    return likely_predicate(n.value, n.case, text) & text.rlike(pattern) & F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: m != "")


def current(chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """Chunks of each object's current generation."""
    return chunks.join(objects.select("object_id", "generation"), ["object_id", "generation"], "left_semi")


def latest(chunks: DataFrame) -> DataFrame:
    """Chunks of the newest generation that each object has."""
    newest = chunks.groupBy("object_id").agg(F.max("generation").alias("generation"))
    return chunks.join(newest, ["object_id", "generation"], "left_semi")


def with_flags(entries: DataFrame, chunks: DataFrame, clauses: list[q.Text]) -> DataFrame:
    """entries with a column _content_i for each clause: whether any chunk of the object matches."""
    if not clauses:
        return entries
    tested = chunks.select("object_id", *(chunk_predicate(c).alias(f"_content_{i}") for i, c in enumerate(clauses)))
    hits = tested.where(reduce(or_, [F.col(f"_content_{i}") for i in range(len(clauses))]))
    hits = hits.groupBy("object_id").agg(*(F.bool_or(f"_content_{i}").alias(f"_content_{i}") for i in range(len(clauses))))
    return entries.join(hits, "object_id", "left").fillna(False, [f"_content_{i}" for i in range(len(clauses))])


def bm25(chunks: DataFrame, query: str) -> DataFrame:
    """object_id, ordinal, score of chunks that hold all of the query's tokens; statistics over all chunks."""
    words = list(dict.fromkeys(query_tokens(query)))
    found = tokens(F.col("text"), longest=LONGEST_TOKEN)
    tf = chunks.select("object_id", "ordinal", F.size(found).alias("length"), *(F.size(F.filter(found, _is(w))).alias(f"tf_{i}") for i, w in enumerate(words)))
    stats = tf.agg(F.count("*").alias("n_chunks"), F.avg("length").alias("mean_length"), *(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(words))))
    matching = tf.where(reduce(and_, [F.col(f"tf_{i}") > 0 for i in range(len(words))], F.lit(bool(words))))
    # the statistics are one row
    scored = matching.withColumn("_k", F.lit(0)).join(F.broadcast(stats.withColumn("_k", F.lit(0))), "_k")
    return scored.select("object_id", "ordinal", _bm25_score([F.col(f"df_{i}") for i in range(len(words))], F.col("n_chunks"), F.col("mean_length")).alias("score"))


def _bm25_score(often: list[Column], n_chunks: Column, mean_length: Column) -> Column:
    """The score of columns tf_0, tf_1, ... and length."""
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / mean_length)

    def part(i: int, df: Column) -> Column:
        return F.log(1 + (n_chunks - df + 0.5) / (df + 0.5)) * F.col(f"tf_{i}") * (K1 + 1) / (F.col(f"tf_{i}") + norm)

    return reduce(lambda a, b: a + b, [part(i, df) for i, df in enumerate(often)], F.lit(0.0))


def bm25_score(words: list[str], often: dict[str, int], n_chunks: int, mean_length: float) -> Column:
    """The same with statistics that are known: how many chunks hold each word, chunks in all, their mean length."""
    return _bm25_score([F.lit(often.get(w, 0)) for w in words], F.lit(n_chunks), F.lit(mean_length))


def _is(word: str):
    return lambda t: t == word


def ranked_objects(chunk_scores: DataFrame, top: int | None = None) -> DataFrame:
    """object_id, score: best chunk plus a tenth of all; over the `top` best chunks, if given."""
    best = chunk_scores if top is None else chunk_scores.orderBy(F.desc("score"), "object_id", "ordinal").limit(top)
    return best.groupBy("object_id").agg((F.max("score") + 0.1 * F.sum("score")).alias("score"))


def verified_objects(chunks: DataFrame, clause: q.Text) -> DataFrame:
    """object_id, score: number of matching chunks, at most MOST_MATCHES."""
    return chunks.where(chunk_predicate(clause)).groupBy("object_id").agg(F.least(F.count("*"), F.lit(MOST_MATCHES)).alias("score"))


def snippets(chunks: DataFrame, word: str) -> DataFrame:
    """object_id, ordinal, line (from 0), snippet, highlight (start, stop in characters): the first matching line of the best chunks of each object."""
    at = F.instr(F.lower("text"), word.lower())
    hits = chunks.where(at > 0).withColumn("at", at - 1).withColumn("n", F.size(F.split(F.lower("text"), F.concat(F.lit(r"\Q"), F.lit(word.lower()), F.lit(r"\E")))) - 1)
    best = Window.partitionBy("object_id").orderBy(F.desc("n"), "ordinal")
    hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= SNIPPETS)
    before = F.substring(F.col("text"), F.lit(1), F.col("at"))
    line = F.size(F.split(before, "\n")) - 1
    start_of_line = F.length(before) - F.length(F.element_at(F.split(before, "\n"), -1))
    whole = F.substring_index(F.substring(F.col("text"), start_of_line + 1, F.length("text")), "\n", 1)
    column = F.col("at") - start_of_line
    begin = F.when(column > SNIPPET_CHARS // 3, column - SNIPPET_CHARS // 3).otherwise(0)
    return hits.select("object_id", "ordinal", line.alias("line"), F.substring(whole, begin + 1, F.lit(SNIPPET_CHARS)).alias("snippet"), (column - begin).alias("start"), (column - begin + len(word)).alias("stop"))


def highlighted(chunks: DataFrame, clauses: list[q.Text], most: int = 32) -> DataFrame:
    """object_id, ordinal, line (from 0), snippet and highlights (start, stop in characters) of any content clauses: the line of the first match in the
    SNIPPETS best chunks of each object, with up to `most` matches of each clause. Chunks are few by then, so they are looked through in Python."""
    import pandas as pd
    import regex

    def pattern(c: q.Text):
        flags = regex.UNICODE if c.case else regex.UNICODE | regex.IGNORECASE
        if c.mode == "regex":
            return regex.compile(c.value, flags | regex.MULTILINE)
        words = query_tokens(c.value)
        if c.mode in ("ranked", "proximity"):
            return regex.compile("|".join(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(w)}(?![\p{{L}}\p{{N}}])" for w in words) or r"(?!)", flags | regex.IGNORECASE)
        if c.mode == "phrase":
            return regex.compile(rf"(?<![\p{{L}}\p{{N}}]){r'[^\p{L}\p{N}]+'.join(map(regex.escape, words))}(?![\p{{L}}\p{{N}}])" if words else r"(?!)", flags | regex.IGNORECASE)
        edge = c.mode == "exact"
        return regex.compile((r"(?<![\p{L}\p{N}])" if edge else "") + regex.escape(c.value) + (r"(?![\p{L}\p{N}])" if edge else ""), flags)

    patterns = [pattern(c) for c in clauses]
    hit = reduce(or_, [chunk_predicate(c) for c in clauses], F.lit(False))
    score = reduce(lambda x, y: x + y, [chunk_predicate(c).cast("int") for c in clauses], F.lit(0))
    best = Window.partitionBy("object_id").orderBy(F.desc("_score"), "ordinal")
    rows = chunks.where(hit).withColumn("_score", score).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= SNIPPETS)

    def run(batches):
        for b in batches:
            out = []
            for object_id, ordinal, text in zip(b["object_id"], b["ordinal"], b["text"]):
                spans = sorted({m.span() for p in patterns for _, m in zip(range(most), p.finditer(text)) if m.end() > m.start()})
                if not spans:
                    continue
                first = spans[0][0]
                start = text.rfind("\n", 0, first) + 1
                stop = text.find("\n", first)
                stop = len(text) if stop < 0 else stop
                begin = max(start, first - SNIPPET_CHARS // 3)
                end = min(stop, begin + SNIPPET_CHARS)
                marks = [(max(x, begin) - begin, min(y, end) - begin) for x, y in spans if x < end and y > begin]
                out.append((object_id, ordinal, text.count("\n", 0, first), text[begin:end], [{"start": x, "stop": y} for x, y in marks]))
            yield pd.DataFrame(out, columns=["object_id", "ordinal", "line", "snippet", "highlights"])

    return rows.select("object_id", "ordinal", "text").mapInPandas(run, "object_id long, ordinal int, line int, snippet string, highlights array<struct<start:int,stop:int>>")


def sanitized(text: Column) -> Column:
    """Control characters (but tab and line ends) and bidirectional marks become U+FFFD."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\u200E\u200F\u202A-\u202E\u2066-\u2069]", "\uFFFD")


def preview(chunks: DataFrame, object_id: int, generation: int, center: int, around: int = 4, most_bytes: int = 262_144) -> DataFrame:
    """The chunk at `center` and neighbours, nearest first, as long as they fit; with whether more follow."""
    near = chunks.where((F.col("object_id") == object_id) & (F.col("generation") == generation))
    bounds = near.agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).withColumn("_k", F.lit(0))
    near = near.where(F.col("ordinal").between(center - around, center + around))
    outward = Window.partitionBy("object_id").orderBy(F.abs(F.col("ordinal") - center), "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("bytes", F.sum(F.octet_length("text")).over(outward)).where(F.col("bytes") <= most_bytes)
    return near.withColumn("_k", F.lit(0)).join(F.broadcast(bounds), "_k").select("ordinal", sanitized(F.col("text")).alias("text"), (F.col("ordinal") > F.col("first")).alias("has_before"), (F.col("ordinal") < F.col("last")).alias("has_after"))


def trigram_postings(chunks: DataFrame) -> DataFrame:
    """trigram, object_id, ordinal; an optional table for candidates."""
    from larkspur.functions.text import trigrams

    return chunks.select(F.explode(trigrams(F.col("text"))).alias("trigram"), "object_id", "ordinal")


def trigram_candidates(postings: DataFrame, literal: str) -> DataFrame:
    """object_id, ordinal of chunks that hold all trigrams of a literal."""
    t = literal.lower()
    wanted = sorted({t[i : i + 3] for i in range(len(t) - 2)})
    return postings.where(F.col("trigram").isin(wanted)).groupBy("object_id", "ordinal").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).drop("n")


def token_stats(chunks: DataFrame) -> DataFrame:
    """token, chunks that hold it, occurrences."""
    each = chunks.select("object_id", "ordinal", F.explode(tokens(F.col("text"), longest=LONGEST_TOKEN)).alias("token"))
    return each.groupBy("token", "object_id", "ordinal").agg(F.count("*").alias("n")).groupBy("token").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("occurrences"))


def duplicate_contents(chunks: DataFrame) -> DataFrame:
    """content hash, number of objects and smallest object of texts that several objects have."""
    h = F.sha2(F.col("text").cast("binary"), 256)
    return chunks.groupBy(h.alias("content_hash")).agg(F.count("*").alias("copies"), F.min("object_id").alias("first_object")).where("copies > 1")

