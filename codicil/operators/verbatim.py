"""Containment joins: which texts hold which strings, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.text import WS, word_shingles
from codicil.scale import is_small, small_or_shuffled
from codicil.session import materialise

ANCHOR = 4
HASHES = 4_000_000  # of 8 bytes, broadcast
MARK_ROWS = 1 << 22  # of 64 marks each, broadcast in place of more hashes
PASS_BYTES = 16 << 20  # of needles that one pass over the texts looks for


def _grams(text: Column, size: int) -> Column:
    # Overlapping windows in one linear pass of the regular expression.
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


# Groups (the sources of one answer) up to this many strings are tested row by
# row; larger ones take the anchor join, whose work does not grow with pairs.
GROUP_ROWS = 256


def by_group_size(df: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of oversized groups or None)."""
    large = df.groupBy(*group).agg(F.count("*").alias("_c")).where(F.col("_c") > GROUP_ROWS).select(*group)
    if large.isEmpty():
        return df, None
    large = small_or_shuffled(large)
    return df.join(large, group, "left_anti"), df.join(large, group, "left_semi")


def bearers(
    needles: DataFrame, texts: DataFrame, needle: str, text: str, key: list[str], within: tuple[str, ...] = (),
    least: int = 1,
) -> DataFrame:
    """(needle columns, key) of every text containing a needle verbatim.

    ``within`` names columns both sides must share; ``least`` is the length of
    the shortest needle.
    """
    needles = needles.where(F.length(needle) >= least)
    if not within:
        return _matched(needles, texts, needle, text, key)
    few, many = by_group_size(needles, list(within))
    own = [c for c in needles.columns if c not in within]
    lists = few.groupBy(*within).agg(F.collect_set(F.struct(*own)).alias("_n"))
    ids = list(dict.fromkeys([*within, *key]))
    held = F.filter("_n", lambda n: F.contains(F.col("_text"), n[needle]))
    rows = (
        texts.select(*ids, F.col(text).alias("_text")).join(lists, list(within))
        .select(*ids, F.explode(held).alias("_h")).select(*ids, "_h.*")
    )
    if many is not None:
        rows = rows.unionByName(_anchored(many, texts, needle, text, key, within, least).select(*rows.columns))
    return rows


def _passes(needles: DataFrame, needle: str) -> Iterator[list[str]]:
    """The distinct needles in lots of about ``PASS_BYTES`` each, dealt by a hash."""
    own = materialise(needles.select(F.col(needle).alias("n")).where("n is not null and n <> ''").distinct(), "needles")
    size = own.agg(F.coalesce(F.sum(F.octet_length("n") + 16), F.lit(0))).first()[0]
    lots = max(1, -(-int(size) // PASS_BYTES))
    for i in range(lots):
        found = [r["n"] for r in own.where(F.pmod(F.xxhash64("n"), F.lit(lots)) == i).collect()]  # bounded by PASS_BYTES
        if found:
            yield found


def _matched(needles: DataFrame, texts: DataFrame, needle: str, text: str, key: list[str]) -> DataFrame:
    """Containment through an automaton over all needles (Aho-Corasick), run along each text once.

    The needles of one pass are bounded in bytes; more of them take further passes over
    the texts.  Needles that begin alike cost no more than others, and nothing but hits leaves a task.
    """
    fields = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in key)
    source = texts.select(*key, F.col(text).cast("string").alias("_text"))
    out = None
    for lot in _passes(needles, needle):

        def scan(batches: Iterator[pa.RecordBatch], lot: list[str] = lot) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for word in lot:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                rows, hits = [], []
                for i, value in enumerate(batch.column(batch.num_columns - 1)):
                    found = {word for _, word in automaton.iter(value.as_py() or "")}
                    rows += [i] * len(found)
                    hits += sorted(found)
                taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(hits, pa.string())], names=[*batch.schema.names[:-1], "_needle"])

        part = source.mapInArrow(scan, f"{fields}, _needle string")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = texts.select(*key, F.lit(None).cast("string").alias("_needle")).limit(0)
    return out.join(needles.withColumnRenamed(needle, "_own"), F.col("_needle") == F.col("_own")).drop("_needle").withColumnRenamed("_own", needle).select(*needles.columns, *key)


def _anchored(needles, texts, needle, text, key, within, least) -> DataFrame:
    """Containment through anchors, for texts of any number.

    A text holding a needle holds the needle's first characters, so the
    candidates come from an equality join on that short anchor and are then
    checked in full.  Only keys travel in the first join; the texts are met
    again by key, where adaptive execution broadcasts the candidates when they
    are few.
    """
    anchored = needles.withColumn("_anchor", F.substring(needle, 1, ANCHOR))
    grams = F.concat(*[_grams(F.col(text), n) for n in range(min(least, ANCHOR), ANCHOR + 1)])
    ids = list(dict.fromkeys([*within, *key]))
    exploded = texts.select(*ids, F.explode(grams).alias("_anchor"))
    candidates = exploded.join(anchored if within else small_or_shuffled(anchored), ["_anchor", *within])
    return (
        candidates.drop("_anchor").distinct()
        .join(texts.select(*ids, F.col(text).alias("_text")), ids)
        .where(F.contains(F.col("_text"), F.col(needle)))
        .drop("_text")
    )


def digit_support(needles: DataFrame, context_tokens: DataFrame, on: str, how: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Join digit tokens to context tokens that contain them.

    ``needles`` has ``on`` and ``token``; ``context_tokens`` has ``on``,
    ``ctx_token`` and ``extra``.  ``how`` is inner (adding ``extra``) or
    left_anti.
    """
    few, many = by_group_size(context_tokens, [on])
    lists = few.groupBy(on).agg(F.collect_set(F.struct("ctx_token", *extra)).alias("_l"))
    joined = needles.join(lists, on, "left")
    test = lambda c: F.contains(c["ctx_token"], F.col("token"))
    if how == "left_anti":
        left = joined.where(~F.coalesce(F.exists("_l", test), F.lit(False))).drop("_l")
        return left if many is None else _digit_join(left, many, on, how, extra)
    found = joined.select(*needles.columns, F.explode(F.filter("_l", test)).alias("_f"))
    rows = found.select(*needles.columns, *[F.col(f"_f.{e}").alias(e) for e in extra])
    return rows if many is None else rows.unionByName(_digit_join(needles, many, on, how, extra))


def _digit_join(needles: DataFrame, context_tokens: DataFrame, on: str, how: str, extra: tuple[str, ...]) -> DataFrame:
    """The same for oversized groups: every number is expanded into its short
    digit groups, so the containment test is an equality join plus a check."""
    anchored = needles.withColumn("_anchor", F.substring("token", 1, ANCHOR))
    grams = F.array_distinct(F.concat(*[_grams(F.col("ctx_token"), n) for n in range(1, ANCHOR + 1)]))
    wide = context_tokens.select(on, *extra, "ctx_token", F.explode(grams).alias("_anchor")).withColumnRenamed(on, "_on")
    rule = (
        (F.col(on) == F.col("_on"))
        & (anchored["_anchor"] == wide["_anchor"])
        & F.contains(F.col("ctx_token"), F.col("token"))
    )
    joined = anchored.join(wide, rule, how)
    return joined.select(*needles.columns, *(extra if how == "inner" else ()))


def phrase_pairs(queries: DataFrame, docs: DataFrame, size: int, key: str, content: str) -> DataFrame:
    """(query_id, key) where a run of ``size`` query words stands verbatim in the text.

    The inner words of a run are whole words of the text, so runs meet the text's runs on
    their inner words.  A run of the text has all that is needed to check the outer ones as
    well, so only true pairs leave the join.  Runs whose inner words no query has are left
    out before anything is moved, as long as the queries' hashes can be broadcast.
    """
    windows = queries.select("query_id", F.explode(F.array_distinct(word_shingles(F.col("text"), size))).alias("phrase"))
    windows = windows.withColumn("_inner", _inner(F.col("phrase"), size))
    # Runs end at any white space but one blank; a class of two characters is matched far faster than the whole one.
    lines = F.regexp_replace(F.lower(content), f"(?! ){WS}", "\n")
    runs = F.regexp_extract_all(lines, F.lit(rf"(?<![^ \n])(?=([^ \n]+(?: [^ \n]+){{{size - 1}}}))"), 1)
    spans = docs.select(key, F.explode(F.array_distinct(runs)).alias("_span")).withColumn("_inner", _inner(F.col("_span"), size))
    wanted = windows.select(F.xxhash64("_inner").alias("_hash")).distinct()
    if is_small(wanted, HASHES):
        spans = spans.withColumn("_hash", F.xxhash64("_inner")).join(F.broadcast(wanted), "_hash", "left_semi")
    else:
        spans = _marked(spans.withColumn("_hash", F.xxhash64("_inner")), wanted)
    found = spans.join(small_or_shuffled(windows), "_inner").where(F.contains(F.col("_span"), F.col("phrase")))
    return found.select("query_id", key).distinct()


def _marked(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """The spans whose ``_hash`` is wanted, and some others whose mark is the same."""
    row, mark = F.pmod("_hash", F.lit(MARK_ROWS)).alias("_row"), F.expr(f"shiftleft(1L, cast(pmod(shiftright(_hash, {MARK_ROWS.bit_length() - 1}), 64) AS int))")
    marks = wanted.groupBy(row).agg(F.bit_or(mark).alias("_marks"))
    return spans.withColumn("_row", row).join(F.broadcast(marks), "_row").where(F.col("_marks").bitwiseAND(mark) != 0).drop("_row", "_marks")


def _inner(run: Column, size: int) -> Column:
    """A run of words without its first and last one."""
    return F.substring_index(F.substring_index(run, " ", size - 1), " ", 2 - size)
