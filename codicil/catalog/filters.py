"""Filters and predicates over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.catalog.base import query
from codicil.catalog.tables import CORPUS, FILES, TASKS, corpus, files, table, tasks
from codicil.functions import answers as fa
from codicil.functions import paths, queries, text, turns
from codicil.operators import changes, filters
from codicil.operators import tasks as ops
from codicil.sources.sinks import prepare_documents


def sql_list(items) -> str:
    return "(" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + ")"


@query("filter_documents", f"WITH {CORPUS} SELECT doc_id, path FROM corpus WHERE category = 'src3' AND language = 'en' AND file_type = '.txt'")
def _(spark, sf):
    return filters.filter_documents(corpus(spark, sf), "src3", "en", ".txt").select("doc_id", "path")


@query("filter_path", "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%blog.th%'")
def _(spark, sf):
    return filters.filter_path(table(spark, sf, "pages"), "BLOG.th", "url").select("page_id", "url")


@query(
    "filter_dates",
    """SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1997-09-30'
 AND o_orderpriority IN ('1-URGENT', '5-LOW')""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").withColumn("modified_at", F.col("o_orderdate"))
    kept = filters.filter_dates(rows, F.lit("1996-03-01").cast("timestamp"), F.lit("1997-09-30").cast("timestamp"))
    return filters.filter_types(kept, ["1-URGENT", "5-LOW"], "o_orderpriority").select("o_orderkey")


@query("filter_score", "SELECT event_id, value / 100 AS score FROM events WHERE value / 100 >= 0.3")
def _(spark, sf):
    scored = table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("score"))
    return filters.filter_score(scored)


@query(
    "select_scannable",
    f"""WITH {FILES}, tree AS (SELECT replace(replace(path, '/AFRICA/', '/.cache/'), '/ASIA/', '/tool.egg-info/') AS path FROM files)
 SELECT path FROM tree WHERE path NOT LIKE '/.cache/%' AND path NOT LIKE '/tool.egg-info/%'
 AND regexp_extract(path, '\\.[a-z]+$') IN ('.txt', '.pdf', '.docx')""",
)
def _(spark, sf):
    # Two regions become a hidden and a build folder.
    path = F.replace(F.replace("path", F.lit("/AFRICA/"), F.lit("/.cache/")), F.lit("/ASIA/"), F.lit("/tool.egg-info/"))
    tree = files(spark, sf).select(path.alias("path"))
    return tree.where(paths.is_scannable(F.col("path")))


@query("exclude_prefix", f"WITH {FILES} SELECT path FROM files WHERE path NOT LIKE '/AFRICA/%'")
def _(spark, sf):
    return changes.exclude_prefix(files(spark, sf).select("path"), "/AFRICA/")


@query(
    "contains_any_term",
    """SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'ere') AND contains(strip_accents(lower(text)), 'ese')
 OR contains(strip_accents(lower(text)), 'vie')""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    body = F.col("text")

    def has(*terms):
        return filters.contains_any_term(body, F.array(*[F.lit(t) for t in terms]))

    return docs.where((has("Ère") & has("ésé")) | has("VIE")).select("doc_id")


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


@query(
    "has_quantity",
    rf"""SELECT doc_id, regexp_matches(text, '\d') OR regexp_matches(text, '{fv.CJK_NUMERAL}')
 OR list_has_any({_WORDS.format('text')}, [{', '.join("'" + w + "'" for w in fv.NUMBER_WORDS)}]) AS quantity FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fa.has_quantity(F.col("text")).alias("quantity"))


@query(
    "is_checkable",
    rf"""WITH s AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
 SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE (regexp_matches(line, '\d') OR regexp_matches(line, '{fv.CJK_NUMERAL}')
 OR list_has_any({_WORDS.format('line')}, [{', '.join("'" + w + "'" for w in fv.NUMBER_WORDS)}]))
 AND length(line) >= 20 AND line[1] NOT IN ('📎', '•')) AS checkable FROM s GROUP BY doc_id""",
)
def _(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(fa.is_checkable(F.col("line"))).alias("checkable")
    )


# Openers put in front of each message so that every intent occurs.
_ASK = """CASE turn % 8 WHEN 0 THEN 'Bonjour ! ' WHEN 1 THEN 'Quelle heure est-il ? ' WHEN 2 THEN 'Qui suis-je ? '
 WHEN 3 THEN 'Who are you? ' WHEN 4 THEN 'Which folders do you read? ' WHEN 5 THEN 'Merci, ' WHEN 6 THEN 'Et ce document : ' ELSE 'Le premier : ' END"""
_ASKED = f"asked AS (SELECT conv_id, turn, role, {_ASK} || CASE WHEN length(text) < 300 THEN role ELSE text END AS message FROM conversations)"


def asked(spark, sf):
    return table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "role", f"{_ASK} || CASE WHEN length(text) < 300 THEN role ELSE text END AS message"
    )


_PLAIN = "plain AS (SELECT *, trim(regexp_replace(strip_accents(lower(message)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM asked)"


def _re(patterns) -> str:
    return "|".join(f"(?:{p.replace('{name}', 'assistant')})" for p in patterns).replace("'", "''")


_INTENT = f"""CASE WHEN regexp_matches(norm, '{_re(fv.TEMPORAL_PATTERNS)}') THEN 'temporal'
 WHEN regexp_matches(norm, '{_re(fv.IDENTITY_USER_PATTERNS)}') THEN 'identity_user'
 WHEN regexp_matches(norm, '{_re(fv.IDENTITY_SELF_PATTERNS)}') THEN 'identity_self'
 WHEN regexp_matches(norm, '{_re(fv.INDEX_SCOPE_PATTERNS)}') THEN 'index_scope' ELSE 'none' END"""
_REST = f"trim(regexp_replace(norm, '{fv.GREETING_PREFIX}', ''))"
_COUNT = "len(list_filter(string_split(rest, ' '), lambda x: x <> ''))"
_SMALL = f"""CASE WHEN rest = '' THEN true WHEN rest <> norm AND {_COUNT} <= 2 AND NOT regexp_matches(rest, '{fv.SMALL_TALK_QUESTION_CUES}')
 THEN true WHEN {_COUNT} > 8 THEN false ELSE regexp_matches(rest, '{_re(fv.SMALL_TALK_PATTERNS)}') END"""
JUDGED = f"{_ASKED}, {_PLAIN}, rested AS (SELECT *, {_REST} AS rest FROM plain), judged AS (SELECT *, {_INTENT} AS intent, {_SMALL} AS small_talk FROM rested)"


@query("config_intent", f"WITH {JUDGED} SELECT conv_id, turn, intent FROM judged")
def _(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", turns.config_intent(F.col("message")).alias("intent"))


@query("is_small_talk", f"WITH {JUDGED} SELECT conv_id, turn, small_talk FROM judged")
def _(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", turns.is_small_talk(F.col("message")).alias("small_talk"))


@query("needs_retrieval", f"WITH {JUDGED} SELECT conv_id, turn FROM judged WHERE intent = 'none' AND NOT small_talk")
def _(spark, sf):
    return asked(spark, sf).where(turns.needs_retrieval(F.col("message"))).select("conv_id", "turn")


def _bounded(patterns) -> str:
    """RE2 form: \\b is ASCII there, so word edges are spelled out."""
    edge = r"(?:^|[^\p{L}\p{N}_])"
    end = r"(?:$|[^\p{L}\p{N}_])"
    out = []
    for p in patterns:
        body = p.replace(r"\b", "")
        out.append(f"{edge if p.startswith(chr(92) + 'b') else ''}{body}{end if p.endswith(chr(92) + 'b') else ''}")
    return "(?i)" + "|".join(f"(?:{p})" for p in out).replace("'", "''")


_TURN_KIND = f"""CASE WHEN regexp_matches(message, '{_bounded(fv.ORDINAL_FIRST)}') THEN 'ordinal_first'
 WHEN regexp_matches(message, '{_bounded(fv.ORDINAL_LAST)}') THEN 'ordinal_last'
 WHEN regexp_matches(regexp_replace(message, '(?i){fv.IMPERSONAL.replace("'", "''")}', ' ', 'g'), '{_bounded(fv.ANAPHORS)}')
 OR (len(list_filter(regexp_split_to_array(message, '\\s+'), lambda x: x <> '')) BETWEEN 1 AND 7
 AND (contains(message, '?') OR regexp_matches(message, '{_bounded([chr(92) + 'b' + c + chr(92) + 'b' for c in fv.FOLLOW_UP_CUES[3:-3].split('|')])}')))
 THEN 'followup' ELSE 'new' END"""


@query("classify_turn", f"WITH {_ASKED} SELECT conv_id, turn, {_TURN_KIND} AS kind FROM asked")
def _(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", turns.classify_turn(F.col("message")).alias("kind"))


@query(
    "names_a_file",
    rf"""SELECT page_id, len(list_filter(regexp_extract_all(lower(url || ' ' || html), '\.([0-9a-z]{{2,5}})(?:$|[^\p{{L}}\p{{N}}_])', 1),
 lambda e: e IN {sql_list(fv.NAMED_FILE_EXTENSIONS)})) > 0 AS named FROM pages""",
)
def _(spark, sf):
    both = F.concat_ws(" ", "url", "html")
    return table(spark, sf, "pages").select("page_id", queries.names_a_file(both).alias("named"))


# Documents without a label have not been stored with a content flag; toxic ones lost their text.
_STORED = """stored AS (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN ' ' ELSE d.text END AS content,
 CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.toxic = 0 END AS has_content FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _stored(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id", F.when(F.col("toxic") == 1, " ").otherwise(F.col("text")).alias("content"),
        (F.col("toxic") == 0).alias("has_content"),
    )


@query("empty_documents", f"WITH {_STORED} SELECT doc_id FROM stored WHERE trim(content) = '' OR NOT coalesce(has_content, false)")
def _(spark, sf):
    return changes.empty_documents(_stored(spark, sf)).select("doc_id")


@query("healthy_ids", f"WITH {_STORED} SELECT doc_id FROM stored WHERE has_content")
def _(spark, sf):
    return changes.healthy_ids(_stored(spark, sf))


@query("has_content", "SELECT doc_id, trim(text) <> '' AS has_content FROM documents")
def _(spark, sf):
    return prepare_documents(table(spark, sf, "documents").withColumnRenamed("text", "content")).select("doc_id", "has_content")


@query(
    "should_expand",
    rf"""WITH q AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_\s\-]|\s', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents)
 SELECT doc_id, len(ws) <= 4 OR list_has_any(ws, [{', '.join("'" + w + "'" for w in fv.ALWAYS_EXPANDED)}]) AS expand FROM q""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", queries.should_expand(F.col("text")).alias("expand"))


@query("get_document", f"WITH {CORPUS} SELECT doc_id, title, content FROM corpus WHERE path = '/corpus/src7/en/doc-7.txt'")
def _(spark, sf):
    return changes.get_document(corpus(spark, sf), "/corpus/src7/en/doc-7.txt", "path").select("doc_id", "title", "content")


@query("find_tasks", f"WITH {TASKS} SELECT id, file_path FROM tasks WHERE contains(file_path, 'cust-1')")
def _(spark, sf):
    return ops.find_tasks(tasks(spark, sf), "cust-1").select("id", "file_path")


@query(
    "needs_ocr",
    """WITH pages_of AS (SELECT l_orderkey AS doc_id, (l_quantity * 10)::BIGINT AS chars, l_returnflag = 'R' AS has_image FROM lineitem),
 p AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE chars > 10) AS with_text, count(*) FILTER (WHERE has_image) AS with_images,
 coalesce(sum(chars) FILTER (WHERE chars > 10), 0)::BIGINT AS chars, count(*) FILTER (WHERE has_image AND chars < 250) AS sparse FROM pages_of GROUP BY doc_id)
 SELECT doc_id, CASE WHEN chars + 2 * greatest(with_text - 1, 0) < 50 OR with_text / pages < 0.3 OR chars / pages < 100
 OR (with_images / pages > 0.8 AND with_text / pages < 0.5) OR sparse / pages >= 0.5
 THEN CASE WHEN sparse / pages >= 0.5 THEN 'scanned_sparse' ELSE 'low_text' END END AS ocr_reason FROM p""",
)
def _(spark, sf):
    return ops.ocr_reason(ops.page_profile(_page_rows(spark, sf))).select("doc_id", "ocr_reason")


def _page_rows(spark, sf):
    """Line items as pages: quantity sets the text length, a returned item is an image page."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") * 10).cast("long").alias("chars"),
        (F.col("l_returnflag") == "R").alias("has_image"),
    )


@query(
    "page_profile",
    """WITH p AS (SELECT l_orderkey AS doc_id, (l_quantity * 10)::BIGINT AS chars, l_returnflag = 'R' AS has_image FROM lineitem)
 SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE chars > 10) AS with_text, count(*) FILTER (WHERE has_image) AS with_images,
 coalesce(sum(chars) FILTER (WHERE chars > 10), 0)::BIGINT AS chars, round(count(*) FILTER (WHERE has_image AND chars < 250) / count(*), 6) AS sparse_ratio
 FROM p GROUP BY doc_id""",
)
def _(spark, sf):
    return ops.page_profile(_page_rows(spark, sf)).select(
        "doc_id", "pages", "with_text", "with_images", "chars", F.round("sparse_ratio", 6).alias("sparse_ratio")
    )


@query(
    "filter_by_language_tag",
    f"WITH {CORPUS} SELECT doc_id FROM corpus WHERE language = 'fr'",
)
def _(spark, sf):
    wanted = text.language_filter_value(F.lit("FRA"))
    return filters.with_language(corpus(spark, sf)).where(F.col("language") == wanted).select("doc_id")
