"""Assembling and judging the context of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.functions.queries import anchor_terms, mentioned_path, names_a_file
from codicil.functions.text import content_fingerprint, is_blank, token_estimate
from codicil.operators.filters import contains_any_term
from codicil.operators.retrieval import top_per_query
from codicil.scale import small_or_shuffled
from codicil.session import materialise


def dedup_by_content(ranked: DataFrame, scope: str = "query_id", rank: str = "rank", row_id: str = "path") -> DataFrame:
    """First row of each content per question in rank order; blank content stays.

    The winner of a content is a partially aggregated minimum, so thousands of
    copies of one text never meet in one task.
    """
    keyed = ranked.withColumn("_fp", content_fingerprint(F.col("content"))).withColumn("_blank", is_blank(F.col("content")))
    group = F.when(F.col("_blank"), F.concat(F.lit("blank:"), F.col(row_id))).otherwise(F.col("_fp"))
    winners = (
        keyed.select(scope, row_id, rank, group.alias("_g"))
        .groupBy(scope, "_g")
        .agg(F.min(F.struct(rank, row_id)).alias("_w"))
        .select(scope, F.col(f"_w.{row_id}").alias(row_id))
    )
    return ranked.join(winners, [scope, row_id], "left_semi")


def anchor_chunks(hits: DataFrame, queries: DataFrame, keyword_paths: DataFrame) -> DataFrame:
    """Replace chunk scores by grounding: 1 if the path is a keyword hit or the
    text holds a term of the question, else 0; without terms the score stays."""
    terms = queries.select("query_id", anchor_terms(F.col("text")).alias("_terms"))
    marks = keyword_paths.select("query_id", "path", F.lit(True).alias("_hit")).distinct()
    joined = hits.join(small_or_shuffled(terms), "query_id").join(marks, ["query_id", "path"], "left")
    text = F.concat_ws(" ", F.coalesce("path", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    grounded = F.col("_hit").isNotNull() | contains_any_term(text, F.col("_terms"))
    score = F.when(F.size("_terms") == 0, F.col("score")).when(grounded, 1.0).otherwise(0.0)
    return joined.withColumn("score", score).drop("_terms", "_hit")


def all_weak(context: DataFrame, scope: str = "query_id") -> DataFrame:
    """(scope, weak): every score is present and below the relevance floor."""
    present = F.coalesce(F.col("score") < fv.WEAK_CONTEXT_SCORE, F.lit(False))
    return context.groupBy(scope).agg(F.bool_and(present).alias("weak"), F.count("*").alias("n_context"))


def closest_titles(context: DataFrame, limit: int = 3, scope: str = "query_id") -> DataFrame:
    """Distinct titles among the first ``limit`` documents, in order."""
    label = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("path"))
    top = top_per_query(context.withColumn("_label", label).withColumnRenamed("rank", "_rank"), limit, [F.asc("_rank")], scope)
    return top.where(F.coalesce("_label", F.lit("")) != "").groupBy(scope).agg(
        # at most ``limit`` labels per question
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_label"))), lambda s: s["_label"])), " | ").alias("titles")
    )


def referent_boost(context: DataFrame, held: DataFrame, scope: str = "query_id") -> DataFrame:
    """Where a document is held, every other score becomes 0; nothing is removed."""
    joined = context.join(held.select(scope, F.col("path").alias("_held")), scope, "left")
    keep = F.col("_held").isNull() | (F.col("_held") == F.col("path"))
    return joined.withColumn("score", F.when(keep, F.col("score")).otherwise(0.0)).drop("_held")


def context_line(rank: Column, title: Column, path: Column, content: Column, category: Column | None = None,
                 deleted: Column | None = None, max_chars: int | None = fv.SUMMARY_CHARS) -> Column:
    """Text block of one ranked document as the prompt shows it."""
    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"    {label}: "), value))

    body = content if max_chars is None else F.substring(content, 1, max_chars)
    notice = F.lit(
        "    ⚠️ DELETED FILE: this source no longer exists on disk (in trash, pending purge). "
        "If you use it, tell the user the file has been deleted."
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), rank.cast("string"), F.lit("] "), title),
        F.when(deleted, notice) if deleted is not None else F.lit(None).cast("string"),
        line("Path", path),
        line("Category", category) if category is not None else F.lit(None).cast("string"),
        line("Content", body),
    )


def section_header(kind: str = "documents") -> str:
    rule = "=" * fv.CONTEXT_RULE_WIDTH
    lead = "The following documents from your local files may be relevant:"
    return "\n".join([rule, "CONTEXT FROM YOUR DOCUMENTS", lead, rule, ""])


def pack_context(ranked: DataFrame, max_tokens: int = fv.CONTEXT_MAX_TOKENS, header_tokens: int | None = None,
                 scope: str = "query_id", rank: str = "rank", text: str = "text") -> DataFrame:
    """Blocks that fit the token budget, in rank order; ``rank`` is unique within ``scope``.

    The first block that overflows is cut to what remains less a reserve of
    50 tokens when that leaves more than 100; nothing follows it.

    Costs alone are dealt to ranges of scope and rank.  A prefix sum is the sum of the
    scope's earlier ranges plus the running sum inside the block's own range, so a scope with
    very many blocks is spread over ranges; texts meet only the blocks that are kept.
    """
    k = fv.CONTEXT_CHARS_PER_TOKEN
    head = len(section_header()) // k if header_tokens is None else header_tokens
    costs = ranked.select(F.col(scope).alias("_scope"), F.col(rank).alias("_rank"), token_estimate(F.col(text), k).alias("_cost"))
    costs = materialise(costs.repartitionByRange("_scope", "_rank").withColumn("_range", F.spark_partition_id()), "context-costs")
    earlier = Window.partitionBy("_scope").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = costs.groupBy("_scope", "_range").agg(F.sum("_cost").alias("_total")).withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    totals = totals.select(F.col("_scope").alias("_of"), F.col("_range").alias("_in"), "_before")
    inside = Window.partitionBy("_scope", "_range").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    upto = costs.join(totals, F.col("_scope").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
    upto = upto.withColumn("_sum", F.lit(head) + F.col("_before") + F.sum("_cost").over(inside))
    before = F.col("_sum") - F.col("_cost")
    # Sums never fall, so only the first overflowing block has a fitting predecessor.
    first_over = (F.col("_sum") > max_tokens) & (before <= max_tokens)
    room = F.lit(max_tokens) - before - 50
    kept = upto.where((F.col("_sum") <= max_tokens) | (first_over & (room > 100))).select("_scope", "_rank", room.alias("_room"), first_over.alias("truncated"))
    rows = ranked.join(kept, F.col(scope).eqNullSafe(F.col("_scope")) & F.col(rank).eqNullSafe(F.col("_rank"))).drop("_scope", "_rank")
    size = F.col("_room") * k
    cut = F.when(F.length(text) > size, F.concat(F.substring(F.col(text), F.lit(1), size.cast("int")), F.lit("..."))).otherwise(F.col(text))
    return rows.withColumn(text, F.when(F.col("truncated"), cut).otherwise(F.col(text))).drop("_room")


# --- verdicts --------------------------------------------------------------------------

FOLLOW_UPS = ("followup", "ordinal_first", "ordinal_last")


def gate_verdict(turns: DataFrame) -> DataFrame:
    """outcome and reason of each turn: proceed, refusal or clarification.

    Expected columns: intent, small_talk, action, turn_kind, stack_size,
    referent_in_context, conflict, asked_last_turn, has_session, n_context,
    weak, any_anchored, missing_terms.  The first rule that applies decides.
    """
    col = F.col
    held = col("action").isin("hold", "recall")
    clarify = ~col("asked_last_turn")
    refused = F.when(col("n_context") > 0, col("weak")).otherwise(~col("has_session"))
    rules = [
        ((col("intent") != "none") | col("small_talk"), "proceed", "gate not applicable"),
        (held & ~col("referent_in_context"), "refusal", "held referent absent"),
        ((col("action") == "hold") & (col("stack_size") >= 2) & col("conflict") & clarify, "clarification", "conflicting referents"),
        (col("turn_kind").isin(*FOLLOW_UPS) & (col("stack_size") == 0) & ~col("has_session") & ~col("any_anchored") & clarify,
         "clarification", "nothing to hold"),
        (refused & col("missing_terms"), "refusal", "terms absent"),
        (refused, "refusal", "no usable context"),
        (col("missing_terms") & (col("action") == "none") & (col("turn_kind") == "new"), "refusal", "context anchored by history"),
    ]
    outcome, reason = F.lit("proceed"), F.lit("context can ground an answer")
    for condition, result, why in reversed(rules):
        hit = F.coalesce(condition, F.lit(False))
        outcome, reason = F.when(hit, result).otherwise(outcome), F.when(hit, why).otherwise(reason)
    return turns.withColumns({"outcome": outcome, "reason": reason})


def refuse_or_answer(intent: Column, small_talk: Column, n_context: Column, weak: Column, has_session: Column) -> Column:
    """answer, reformulate or refuse, before any verbatim proof."""
    return (
        F.when((intent != "none") | small_talk, "answer")
        .when(n_context > 0, F.when(weak, "reformulate").otherwise("answer"))
        .when(has_session, "answer")
        .otherwise("refuse")
    )


def named_file_advisory(queries: DataFrame, covered: DataFrame, watched: DataFrame) -> DataFrame:
    """(query_id, advisory, named_path) of questions naming a file absent from the context.

    ``covered`` lists questions whose named file was retrieved; ``watched`` the
    scan roots.  not_indexed, unwatched or absent.
    """
    from codicil.operators.changes import under_roots

    asked = queries.where(names_a_file(F.col("text"))).join(covered.select("query_id"), "query_id", "left_anti")
    named = asked.select("query_id", mentioned_path(F.col("text")).alias("named_path"))
    inside = under_roots(named.where("named_path <> ''"), watched, "named_path").select("query_id", F.lit(True).alias("_in"))
    kind = (
        F.when(F.col("named_path") == "", "absent").when(F.col("_in").isNotNull(), "not_indexed").otherwise("unwatched")
    )
    return named.join(inside, "query_id", "left").select("query_id", kind.alias("advisory"), "named_path")
