"""Conversation history: last turns, widened questions, notices, referents."""

from __future__ import annotations

from pyspark.sql import functions as F

from codicil.catalog.base import query
from codicil.catalog.filters import _ASK, JUDGED, asked
from codicil.catalog.grounding import index_of, referents_sql
from codicil.catalog.tables import corpus, table
from codicil.functions import turns
from codicil.operators import context, conversation, pins
from codicil.operators.posting_index import indexed_search


def _turns(spark, sf):
    return table(spark, sf, "conversations")


@query("last_user_turn", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def _(spark, sf):
    return conversation.last_user_turn(_turns(spark, sf))


@query(
    "recent_user_query",
    """SELECT conv_id, turn, trim(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS query
 FROM conversations WHERE role = 'user' AND text <> ''""",
)
def _(spark, sf):
    return conversation.recent_user_query(_turns(spark, sf))


@query(
    "previous_assistant_was",
    """SELECT conv_id, turn, coalesce(asked, false) AS asked FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'assistant' THEN starts_with(text, 'E') END IGNORE NULLS)
 OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations) WHERE role = 'user'""",
)
def _(spark, sf):
    return conversation.previous_assistant_was(_turns(spark, sf), "E")


_SHARED = """shared AS (SELECT c.conv_id, c.turn, trim(c.text) AS attachment FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY conv_id) l
 ON c.conv_id = l.conv_id WHERE c.role = 'user' AND c.turn < last AND trim(c.text) <> '')"""


@query("prior_attachments", f"WITH {_SHARED} SELECT conv_id, turn, attachment FROM shared")
def _(spark, sf):
    return conversation.prior_attachments(_turns(spark, sf))


@query("join_attachments", f"WITH {_SHARED} SELECT conv_id, string_agg(attachment, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS attachments FROM shared GROUP BY conv_id")
def _(spark, sf):
    return conversation.join_attachments(conversation.prior_attachments(_turns(spark, sf)))


_WARN = "'\n\n⚠️ Fiabilité : 1 détail.'"


@query(
    "strip_notices",
    f"""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN rtrim(text, ' ' || chr(10)) ELSE 'ℹ️ Réponse générale — pas issue de vos documents.' || chr(10) || chr(10) || text || {_WARN} END AS text FROM conversations""",
)
def _(spark, sf):
    decorated = F.concat(F.lit("ℹ️ Réponse générale — pas issue de vos documents.\n\n"), "text", F.lit("\n\n⚠️ Fiabilité : 1 détail."))
    return conversation.clean_history(_turns(spark, sf).withColumn("text", decorated)).select("conv_id", "turn", "text")


@query(
    "context_source",
    f"""WITH {JUDGED} SELECT conv_id, turn, CASE WHEN intent <> 'none' THEN 'config' WHEN turn > 3 THEN 'docs' WHEN role = 'assistant' THEN 'session' ELSE 'none' END AS source FROM judged""",
)
def _(spark, sf):
    intent = turns.config_intent(F.col("message"))
    return asked(spark, sf).select(
        "conv_id", "turn", turns.context_source(intent, F.col("turn") - 3, F.col("role") == "assistant").alias("source")
    )


# Gate inputs from the turn itself: every rule of the gate meets some turns.
_GATE = """gate AS (SELECT conv_id, turn, intent, small_talk, CASE turn % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'hold' ELSE 'recall' END AS action,
 CASE turn % 2 WHEN 0 THEN 'new' ELSE 'followup' END AS turn_kind, turn % 4 AS stack_size, role = 'user' AS referent_in_context, length(message) > 900 AS conflict,
 turn = 5 AS asked_last_turn, role = 'assistant' AS has_session, length(message) % 5 AS n_context, length(message) % 2 = 0 AS weak, length(message) % 3 = 0 AS any_anchored,
 length(message) > 400 AS missing_terms FROM judged)"""
_GATE_COLUMNS = _GATE[len("gate AS (SELECT "):_GATE.rindex(" FROM judged")]


@query(
    "gate_verdict",
    f"""WITH {JUDGED}, {_GATE}, r AS (SELECT *, CASE WHEN n_context > 0 THEN weak ELSE NOT has_session END AS refused FROM gate)
 SELECT conv_id, turn, CASE WHEN intent <> 'none' OR small_talk THEN 'proceed' WHEN action IN ('hold', 'recall') AND NOT referent_in_context THEN 'refusal'
 WHEN action = 'hold' AND stack_size >= 2 AND conflict AND NOT asked_last_turn THEN 'clarification'
 WHEN turn_kind = 'followup' AND stack_size = 0 AND NOT has_session AND NOT any_anchored AND NOT asked_last_turn THEN 'clarification'
 WHEN refused THEN 'refusal' WHEN missing_terms AND action = 'none' AND turn_kind = 'new' THEN 'refusal' ELSE 'proceed' END AS outcome FROM r""",
)
def _(spark, sf):
    from codicil.catalog.tables import _split

    judged = asked(spark, sf).withColumns(
        {"intent": turns.config_intent(F.col("message")), "small_talk": turns.is_small_talk(F.col("message"))}
    )
    return context.gate_verdict(judged.selectExpr(*_split(_GATE_COLUMNS))).select("conv_id", "turn", "outcome")


@query(
    "adequacy",
    f"""WITH {JUDGED} SELECT conv_id, turn, CASE WHEN intent <> 'none' OR small_talk THEN 'answer' WHEN length(message) % 5 > 0 THEN CASE WHEN length(message) % 2 = 0 THEN 'reformulate' ELSE 'answer' END
 WHEN role = 'assistant' THEN 'answer' ELSE 'refuse' END AS decision FROM judged""",
)
def _(spark, sf):
    message = F.col("message")
    decision = context.refuse_or_answer(
        turns.config_intent(message), turns.is_small_talk(message), F.length(message) % 5, F.length(message) % 2 == 0, F.col("role") == "assistant"
    )
    return asked(spark, sf).select("conv_id", "turn", decision.alias("decision"))


@query(
    "named_file_advisory",
    r"""WITH asks AS (SELECT page_id AS query_id, CASE page_id % 3 WHEN 0 THEN 'open /pages/' || page_id || '/a.pdf please' WHEN 1 THEN 'open /other/' || page_id || '.md now' ELSE 'open note.txt ' || url END AS text FROM pages)
 SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'not_indexed' WHEN 1 THEN 'unwatched' ELSE 'absent' END AS advisory FROM asks""",
)
def _(spark, sf):
    ask = F.expr(
        "CASE page_id % 3 WHEN 0 THEN 'open /pages/' || page_id || '/a.pdf please' WHEN 1 THEN 'open /other/' || page_id || '.md now'"
        " ELSE 'open note.txt for ' || page_id END"
    )
    asks = table(spark, sf, "pages").select(F.col("page_id").alias("query_id"), ask.alias("text"))
    watched = table(spark, sf, "pages").select(F.concat(F.lit("/pages/"), "page_id").alias("root")).distinct()
    nothing = asks.select("query_id").limit(0)
    return context.named_file_advisory(asks, nothing, watched).select("query_id", "advisory")


def resolved_turns(spark, sf):
    """User turns with the document they quote and the one a search finds."""
    users = asked(spark, sf).where("role = 'user'").withColumn("query_id", F.concat_ws("/", "conv_id", "turn"))
    asks = users.select("query_id", F.col("message").alias("text"))
    docs = corpus(spark, sf).select("path", "content")
    quoted = pins.phrase_match(asks, docs, key="path").groupBy("query_id").agg(F.min("path").alias("named_path"))
    found = indexed_search(asks, index_of(spark, sf, "path"), 1).select("query_id", F.col("path").alias("fallback_path"))
    return (
        users.select("conv_id", "turn", "query_id", F.col("message").alias("text"))
        .join(quoted, "query_id", "left").join(found, "query_id", "left").drop("query_id")
    )


@query(
    "referent_stack",
    f"""WITH RECURSIVE {referents_sql(f"{_ASK} || CASE WHEN length(text) < 300 THEN role ELSE text END")}
 SELECT conv_id, turn, kind AS turn_kind, action, referent, len(before)::INT AS stack_size FROM fold WHERE turn IS NOT NULL""",
)
def _(spark, sf):
    return conversation.referent_stack(resolved_turns(spark, sf))


@query(
    "stack_anchor",
    """SELECT source AS query_id, '/d/' || doc_id AS path, contains(strip_accents(lower('/d/' || doc_id || ' ' || doc_id || ' ' || text)), 'tion') OR contains(lower(text), 'heit') AS anchored FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("query_id"), F.concat(F.lit("/d/"), "doc_id").alias("path"),
        F.col("doc_id").cast("string").alias("title"), F.col("text").alias("content"),
    )
    asks = docs.select("query_id").distinct().withColumn("text", F.lit("Tion, heit?"))
    return conversation.stack_anchor(docs.select("query_id", "path"), docs.drop("query_id"), asks)
