"""Personal data: fixed patterns, and identifiers learned from their contexts.

Everything runs on built-in functions.  The base patterns find e-mail addresses,
IPv4 addresses, card numbers and phone numbers.  These are the seeds of a
bootstrapping step over all *candidates* of the corpus: tokens that hold a digit or a
sign between letters or digits, and runs of tokens with digits.  A lexical pattern is the words
around a candidate (the word before; the two words before; the word before and the
one behind) and the candidate's shape.  Patterns and instances are a graph:
a pattern is as good as the instances it introduces, an instance as good as the
patterns that introduce it.  Instances that become trusted are seeds of the next round, so a
later round can reach patterns that no base span has.  What trusted patterns
introduce and no base span overlaps is added as spans of kind ``context``.

Stop words prove nothing: a pattern counts only if one of its words is *telling*, that
is, if ``TELLING`` of its occurrences in the whole corpus stand at that place beside a
candidate.  Texts are read twice: once for spans and candidates, once for the numbers of words.

The patterns below match what the plain ones in the comments match, but start only
where a match can start and never step back, so a run of any length takes linear
time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codicil.llm.shared import stage

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
ROUNDS = 3
MIN_SEEDS = 5  # distinct ones, of a pattern
MIN_SCORE = 0.8
MIN_SHARE = 0.5  # of the places of a pattern that hold trusted instances: distinct words run out as a corpus grows, identifiers do not
TELLING = 0.5  # of the occurrences of a word

# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+ where it has 16 digits or more
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+"
# \+[0-9][\x20().0-9-]+[0-9]
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Where a piece of text starts: after white space, ":" or "=".
_STARTS = r"(?<=[\s:=])(?![\s:=])"
_SPACE = " \t\n\x0b\f\r"
_OPENING, _CLOSING = "\"'`([{<*_~|", ".,;!?\"'`)]}>*_~|"
_LETTER = r"[^\x00-@\[-`{-\x7F]"  # ASCII letters and all beyond ASCII
_ALNUM = r"[^\x00-/:-@\[-`{-\x7F]"
_SIGN = r"[^\s:=,;!?\"'`\x000-9A-Za-z\x80-\x{10FFFF}-]"
_INSIDE = r"(?:[^\s:=,;]|,(?=[0-9]))"
# A token with a digit or with a sign between letters and digits; from a token without letters on, the tokens with digits behind it too.
_CANDIDATE = (
    r"(?<![^\s:=\"'`(\[{<*_~|])(?:"
    rf"\+?(?=[^\s:=,;A-Za-z\x80-\x{{10FFFF}}]*+(?:[\s,;:=]|$))[(]?[0-9]{_INSIDE}*+(?:\x20(?=[^\s:=,;]*[0-9]){_INSIDE}++|\x20[xX*#]{{2,}}+(?=\x20[^\s:=,;]*[0-9]))*+"
    rf"|\+?(?:{_LETTER}|['\u2019-])*+(?:[0-9]|(?<={_ALNUM}){_SIGN}++(?={_ALNUM}))[^\s:=]*+)"
)
_WORDS_BEFORE = r"^[\"'`(\[{<*_~|]*+([\s:=]++[^\s:=]++)?+([\s:=]++[^\s:=]++)?+"  # of the text before, turned round
_WORD_BEHIND = r"^\s*+(\S++)?+"

_PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
_BLOCK = 256


def _possible(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))


def _luhn(number: Column) -> Column:
    """Check digit of a string of up to 19 digits."""
    backwards = F.split(F.reverse(number), "")
    digits = F.transform(
        backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int"))
    )
    return F.aggregate(digits, F.lit(0), lambda a, d: a + d) % 10 == 0


def _accepted(kind: str, found: Column, /) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda s: _accepted(kind, s["text"])


def _located(df: DataFrame, name: str, pattern: str, possible: Column, words: bool = False) -> DataFrame:
    """Adds ``name``: array of (start, end, text) of the pattern's matches in column ``_text``; with ``words`` also ``before2, before1, behind``."""
    text, none = F.col("_text"), F.array().cast("array<string>")
    df = df.withColumn("_found", F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size("_found") > 0
    df = df.withColumn("_pieces", F.when(some, F.split(text, pattern, -1)).otherwise(none))
    steps = F.zip_with(F.slice("_pieces", 1, F.size("_found")), F.col("_found"), lambda p, m: F.length(p) + F.length(m))
    df = df.withColumn("_steps", F.when(some, steps).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_blocks", F.when(some, _block_sums("_steps")).otherwise(F.array().cast("array<int>")))

    def span(own: Column, i: Column) -> Column:
        start = _sum_before("_steps", "_blocks", i) + F.length(F.get("_pieces", i))
        fields = [start.alias("start"), (start + F.length(own)).alias("end"), own.alias("text")]
        return F.struct(*fields, *(_around(i) if words else []))

    df = df.withColumn(name, F.transform("_found", span))
    return df.drop("_found", "_pieces", "_steps", "_blocks")


def _around(i: Column) -> list[Column]:
    """The pieces of text before (turned round) and behind match ``i``."""
    turned = F.reverse(F.get("_pieces", i))
    return [F.regexp_extract(turned, _WORDS_BEFORE, k).alias(n) for k, n in ((2, "before2"), (1, "before1"))] + [F.regexp_extract(F.get("_pieces", i + 1), _WORD_BEHIND, 1).alias("behind")]


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def _block_sums(steps: str) -> Column:
    """Sums of the array's first 0, 1, 2 ... whole blocks."""
    last = F.floor((F.size(steps) - 1) / _BLOCK).cast("int")
    own = F.transform(F.sequence(F.lit(0), last), lambda b: _total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("sums"))
    return F.aggregate(own, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["sums"], F.array(a["sum"])).alias("sums")))["sums"]


def _sum_before(steps: str, blocks: str, i: Column) -> Column:
    block = F.floor(i / _BLOCK).cast("int")
    return F.get(blocks, block) + _total(F.slice(steps, block * _BLOCK + 1, i - block * _BLOCK))


def _word(piece: Column) -> Column:
    """A piece of text as a word of a pattern, null if it is empty.

    Lower case, bare of punctuation but a closing ":" or "=" (of marks alone, the marks); ``#`` if it holds a digit.
    """
    marks = F.rtrim(piece, F.lit(_SPACE))
    bare = F.lower(F.ltrim(F.rtrim(marks, F.lit(_CLOSING + _SPACE)), F.lit(_OPENING)))
    return F.when(piece == "", F.lit(None)).when(piece.rlike("[0-9]"), F.lit("#")).when(bare == "", marks).otherwise(bare)


def base_spans(documents: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns in ``keep`` (as ``c0``, ``c1`` ...), the text, and for each kind, as ``_<kind>``, an array of (start, end, text).

    Offsets are code points, ends exclusive; matches are leftmost and do not overlap
    within a kind; those that fail their test are dropped.  A null text counts as empty.
    """
    df = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"))
    for kind, pattern in _PATTERNS.items():
        df = _located(df, f"_{kind}", pattern, _possible(kind, F.col("_text")))
    df = df.withColumns({f"_{kind}": F.filter(f"_{kind}", _test(kind)) for kind in KINDS if kind != "email"})
    return df


def _is_base(text: Column, whole: bool) -> Column:
    """Whether a text is, or holds, what the base patterns accept."""
    out = F.lit(False)
    for kind, pattern in _PATTERNS.items():
        if whole:
            out = out | (text.rlike(f"^(?:{pattern})$") & _accepted(kind, text))
        else:
            found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            out = out | (_possible(kind, text) & F.exists(found, functools.partial(_accepted, kind)))
    return out


def _candidates(found: DataFrame) -> DataFrame:
    """``id, text_hash, start, end, instance, seed, before2, before1, behind, shape`` of all candidates but those that only hold a base span."""
    df = found.select("id", "text_hash", F.explode("_candidates").alias("c")).select("id", "text_hash", "c.*")
    df = df.withColumn("instance", F.rtrim("text", F.lit(_CLOSING + "-")))
    df = df.withColumn("end", F.col("start") + F.length("instance")).where("instance != ''")
    df = df.withColumn("seed", _is_base(F.col("instance"), whole=True)).where(F.col("seed") | ~_is_base(F.col("instance"), whole=False))
    words = {n: _word(F.reverse(n)) for n in ("before1", "before2")} | {"behind": _word(F.col("behind"))}
    return df.withColumns(words).select("id", "text_hash", "start", "end", "instance", "seed", "before2", "before1", "behind", _shape(F.col("instance")).alias("shape"))


def _shape(text: Column) -> Column:
    """What an instance is made of: mostly digits or letters, any digit, signs inside, several tokens."""
    digits, letters = F.length(F.regexp_replace(text, "[^0-9]", "")), F.length(F.regexp_replace(text, f"(?!{_LETTER}).", ""))
    return F.concat(
        F.when(digits > letters, "9").otherwise("a"), F.when(digits > 0, "9").otherwise(""),
        F.when(text.rlike(r"[^\sA-Za-z0-9\x80-\x{10FFFF}]"), ".").otherwise(""), F.when(text.contains(" "), "_").otherwise(""),
    )


_PLACES = ("before2", "before1", "behind")


def _contexts(candidates: DataFrame) -> DataFrame:
    """The candidates, a row for each pattern they are in: ``pattern`` (before2, before1, behind, shape; null where it does not look)."""
    none, marks = F.lit(None).cast("string"), F.col("before1").isNotNull()
    forms = [
        F.when(marks, F.struct(none.alias("before2"), "before1", none.alias("behind"), "shape")),
        F.when(marks & F.col("before2").isNotNull(), F.struct("before2", "before1", none.alias("behind"), "shape")),
        F.when(marks & F.col("behind").isNotNull(), F.struct(none.alias("before2"), "before1", "behind", "shape")),
    ]
    df = candidates.withColumn("pattern", F.explode(F.filter(F.array(*forms), lambda p: p.isNotNull())))
    return df.select("id", "text_hash", "start", "end", "instance", "seed", "pattern")


def _telling(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """``place, word`` of the words of which ``TELLING`` of all occurrences stand at ``place`` beside a candidate."""
    pieces = texts.select(F.explode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), _STARTS, -1)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    totals = pieces.select(_word(F.col("piece")).alias("word"), "n").where("word is not null and word != '#'").groupBy("word").agg(F.sum("n").alias("n"))
    beside = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.col(p).alias("word")) for p in _PLACES])).alias("b")
    near = candidates.select(beside).select("b.*").where("word is not null and word != '#'").groupBy("place", "word").agg(F.count("*").alias("near"))
    return near.join(totals, "word").where(F.col("near") >= TELLING * F.col("n")).select("place", "word")


def _with_telling_words(patterns: DataFrame, telling: DataFrame) -> DataFrame:
    """The patterns that have a telling word at one of their places."""
    words = F.array(*[F.struct(F.lit(p).alias("place"), F.col(f"pattern.{p}").alias("word")) for p in _PLACES])
    own = patterns.select("pattern", F.explode(words).alias("w")).select("pattern", "w.*")
    return own.join(telling, ["place", "word"], "left_semi").select("pattern").distinct()


def bootstrap(seen: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE, min_share: float = MIN_SHARE) -> DataFrame:
    """``pattern, instance`` pairs that are trusted, from rows ``pattern, instance, seed`` (a row for each place).

    A pattern's score is the mean score of its distinct instances (smoothed by one
    unknown instance); an unknown instance's score is the probability that at least one
    of its patterns is right.  Seeds keep the score 1; an instance whose score
    reaches ``min_score`` counts as a seed in the rounds after.  A pattern counts if it has
    ``min_seeds`` distinct seeds or more and these fill ``min_share`` of its places; it is
    trusted if its score also reaches ``min_score``.
    """
    edges = stage(seen.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("int")).alias("seed"), F.count("*").alias("n")), "pattern-graph")
    scores = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        trusted = F.col("score") >= min_score
        patterns = scores.groupBy("pattern").agg(
            (F.sum("score") / (F.count("*") + 1.0)).alias("p_score"), F.sum(trusted.cast("int")).alias("seeds"),
            F.sum(F.when(trusted, F.col("n")).otherwise(0)).alias("filled"), F.sum("n").alias("places"),
        )
        counts = (F.col("seeds") >= min_seeds) & (F.col("filled") >= min_share * F.col("places"))
        scored = edges.join(patterns.select("pattern", F.when(counts, F.col("p_score")).otherwise(0.0).alias("p_score")), "pattern")
        doubt = F.sum(F.log(F.lit(1.0) - F.least(F.col("p_score"), F.lit(0.999999))))
        instances = scored.where("seed = 0").groupBy("instance").agg((F.lit(1.0) - F.exp(doubt)).alias("i_score"))
        score = F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("i_score", F.lit(0.0)))
        scores = stage(scored.join(instances, "instance", "left").select("pattern", "instance", "seed", "n", "p_score", score.alias("score")), "pattern-scores")
    return scores.where((F.col("seed") == 0) & (F.col("p_score") >= min_score)).select("pattern", "instance")


def _free_of_base(hits: DataFrame, found: DataFrame) -> DataFrame:
    """The hits that overlap no base span of their text; one sort a text, however many it has of both."""
    keys = ["id", "text_hash"]
    bases = found.join(hits.select(F.col("id").alias("_i"), F.col("text_hash").alias("_h")).distinct(), F.col("id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h")), "left_semi")
    bases = bases.select(*keys, F.explode(F.concat(*KINDS)).alias("b")).select(*keys, "b.start", "b.end", F.lit(True).alias("base")).distinct()
    own = W.partitionBy(*keys).orderBy("start", F.desc("base"))
    before, behind = own.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys).orderBy(F.desc("start"), "base").rowsBetween(W.unboundedPreceding, -1)
    both = bases.unionByName(hits.select(*keys, "start", "end", F.lit(False).alias("base")).distinct())
    both = both.withColumns({"_last": F.max(F.when(F.col("base"), F.col("end"))).over(before), "_next": F.min(F.when(F.col("base"), F.col("start"))).over(behind)})
    return both.where(~F.col("base") & (F.coalesce("_last", F.lit(0)) <= F.col("start")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("end")))).select(*keys, "start", "end")


def find_personal_data(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document ``id``, ``text_hash`` and one array of (start, end) per kind, ``context`` last.

    Rows equal in id and text have equal results and are returned as often as they
    occur; an empty table gives no rows; other columns are not read.
    """
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    df = _located(base_spans(texts, ["id"]), "_candidates", _CANDIDATE, F.lit(True), words=True)
    spans = [F.transform(f"_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS]
    found = stage(df.select(F.col("c0").alias("id"), F.xxhash64("_text").alias("text_hash"), *spans, "_candidates"), "personal-data")

    candidates = stage(_candidates(found), "candidates")
    contexts = _contexts(candidates)
    # A pattern that no telling word is in, or that has too few instances to count in any round, is left out here.
    many = contexts.groupBy("pattern").agg(F.count_distinct("instance").alias("instances")).where(F.col("instances") >= MIN_SEEDS).select("pattern")
    patterns = stage(_with_telling_words(many, _telling(texts, candidates)), "patterns")
    contexts = stage(contexts.join(patterns, "pattern", "left_semi"), "contexts")
    trusted = contexts.where("not seed").join(bootstrap(contexts.select("pattern", "instance", "seed")), ["pattern", "instance"], "left_semi")
    hits = _free_of_base(stage(trusted.select("id", "text_hash", "start", "end").distinct(), "introduced"), found)
    by_text = hits.groupBy(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(CONTEXT))  # of one text
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return found.join(by_text, same, "left").select("id", "text_hash", *KINDS, F.coalesce(CONTEXT, empty).alias(CONTEXT))


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, by kind as given, then start, joined by commas."""

    def written(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(written, kinds)), ",")


def all_spans() -> Column:
    """(start, end, kind) of all spans, sorted."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*map(named, (*KINDS, CONTEXT))))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each of ``spans`` (start, end, kind; sorted, any overlaps) replaced by ``[KIND]``."""

    def piece(s: Column, i: Column) -> Column:
        before = F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda x: x["end"])), F.lit(0))
        plain = F.when(s["start"] > before, F.substring(text, before + 1, s["start"] - before)).otherwise(F.lit(""))
        return F.when(s["start"] >= before, F.concat(plain, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))

    last = F.coalesce(F.array_max(F.transform(spans, lambda x: x["end"])), F.lit(0))
    return F.concat(F.array_join(F.transform(spans, piece), ""), text.substr(last + 1, F.length(text)))
