"""Audit of answers: sentence roles, grounding, citations, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from codicil.catalog.base import query
from codicil.catalog import tables
from codicil.catalog.tables import ANSWERS, table
from codicil.functions.answers import digit_tokens
from codicil.operators import audit
from codicil.operators.retrieval import embed_hashed
from codicil.session import materialise

_SPLIT = r"""sents AS (SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY p) - 1)::INT AS sentence_no, s AS sentence FROM (
 SELECT answer_id, generate_subscripts(parts, 1) AS p, trim(unnest(parts), ' ' || chr(10)) AS s FROM (SELECT answer_id,
 string_split(regexp_replace(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS parts FROM answers)) WHERE s <> '')"""
_NUM = r"'\d{1,3}(?:[\s.,]\d{3})+|\d+[.,]\d+|\d+'"


def _digits(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, {_NUM}), lambda t: regexp_replace(t, '\D', '', 'g'))"


# A source is named when its file name or bare title stands in the sentence; "line-1" must not match inside "line-12".
# Titles are "line-" and a number, so the titles a sentence spells out meet the sources by equality.
_NAMED = """spelt AS (SELECT DISTINCT answer_id, sentence_no, unnest(regexp_extract_all(lower(sentence), '(?:^|[^a-z0-9])(line-[0-9]+)', 1)) AS title FROM sents),
 named AS (SELECT answer_id, sentence_no, list(DISTINCT path ORDER BY path) AS cited FROM spelt JOIN contexts USING (answer_id, title) GROUP BY answer_id, sentence_no)"""
_BARE = "regexp_replace(regexp_replace(lower(sentence), 'line-[0-9]+(\\.md)?', ' ', 'g'), 'x^', '')"
_ROLES = rf"""{ANSWERS}, {_SPLIT}, {_NAMED}, roles AS (SELECT answer_id, sentence_no, sentence, coalesce(cited, []) AS cited,
 CASE WHEN sentence[1] = '⚠' THEN 'notice' WHEN cited IS NOT NULL THEN CASE WHEN regexp_matches({_BARE}, '\d') OR list_has_any(string_split({_BARE}, ' '),
 ['six', 'mille']) THEN 'citation' ELSE 'echo_metadata' END WHEN sentence LIKE 'Le premier document%' THEN 'habillage' ELSE 'affirmation' END AS role
 FROM sents LEFT JOIN named USING (answer_id, sentence_no))"""


def answers(spark, sf):
    """The derived answers as a stored table, which is what an audit reads."""
    return materialise(tables.answers(spark, sf), "answers")


def contexts(spark, sf):
    return materialise(tables.contexts(spark, sf), "contexts")


def _rows(spark, sf):
    return audit.answer_sentences(answers(spark, sf))


def _roles(spark, sf, sources=None):
    # Read several times by every check that follows.
    return materialise(audit.sentence_roles(_rows(spark, sf), contexts(spark, sf) if sources is None else sources), "roles")


@query("answer_sentences", f"WITH {ANSWERS}, {_SPLIT} SELECT answer_id, sentence_no, sentence FROM sents")
def _(spark, sf):
    return _rows(spark, sf)


_FAB = r"""cand AS (SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY p) - 1)::INT AS pos, c AS candidate FROM (SELECT answer_id, min(p) AS p, c FROM (
 SELECT answer_id, generate_subscripts(f, 1) AS p, unnest(f) AS c FROM (SELECT answer_id, regexp_extract_all(text, '(?i)[^\s"''`«»()\[\]{},;:]+\.(?:pdf|docx?|md|txt)\b') AS f FROM answers))
 GROUP BY answer_id, c)), fab AS (SELECT answer_id, pos, candidate FROM cand WHERE NOT EXISTS (SELECT 1 FROM contexts x WHERE x.answer_id = cand.answer_id
 AND (lower(candidate) IN (x.path, split_part(x.path, '/', -1), x.title) OR regexp_extract(candidate, '^(.*)\.[a-z]+$', 1) = x.title)))"""


@query("cited_files", f"WITH {ANSWERS}, {_FAB} SELECT answer_id, pos, candidate FROM cand")
def _(spark, sf):
    return audit.cited_files(answers(spark, sf))


@query("fabricated_citations", f"WITH {ANSWERS}, {_FAB} SELECT answer_id, pos, candidate FROM fab")
def _(spark, sf):
    return audit.fabricated_citations(answers(spark, sf), contexts(spark, sf))


@query(
    "sanitize_citations",
    f"""WITH {ANSWERS}, {_FAB} SELECT a.answer_id, coalesce(replace(text, candidate, '[source non vérifiée retirée]'), text) AS text,
 (candidate IS NOT NULL)::INT AS n_removed FROM answers a LEFT JOIN fab USING (answer_id)""",
)
def _(spark, sf):
    return audit.sanitize_citations(answers(spark, sf), contexts(spark, sf)).select("answer_id", "text", "n_removed")


_TRASHED = "trash AS (SELECT DISTINCT '/orders/' || l_orderkey || '/line-' || l_linenumber || '.md' AS path FROM lineitem WHERE l_returnflag = 'R')"


@query(
    "deleted_citations",
    f"""WITH {ANSWERS}, {_TRASHED} SELECT DISTINCT c.answer_id, split_part(c.path, '/', -1) AS name FROM contexts c JOIN trash USING (path)
 JOIN answers a ON a.answer_id = c.answer_id WHERE contains(lower(text), c.title)""",
)
def _(spark, sf):
    gone = table(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr(
        "'/orders/' || l_orderkey || '/line-' || l_linenumber || '.md' AS path"
    )
    return audit.deleted_citations(answers(spark, sf), contexts(spark, sf), gone)


@query("sentence_roles", f"WITH {_ROLES} SELECT answer_id, sentence_no, role, array_to_string(cited, ' ') AS cited FROM roles")
def _(spark, sf):
    return _roles(spark, sf).select("answer_id", "sentence_no", "role", F.array_join("cited", " ").alias("cited"))


@query(
    "role_counts",
    f"WITH {_ROLES} SELECT answer_id, " + ", ".join(f"count(*) FILTER (WHERE role = '{r}') AS {r}" for r in ("notice", "echo_metadata", "citation", "habillage", "affirmation")) + " FROM roles GROUP BY answer_id",
)
def _(spark, sf):
    return audit.role_counts(_roles(spark, sf))


_CTXD = f"""ctxd AS (SELECT DISTINCT answer_id, path, unnest({_digits('content')}) AS d FROM contexts),
 alld AS (SELECT DISTINCT answer_id, d FROM ctxd UNION SELECT answer_id, unnest({_digits("title || ' ' || path")}) FROM contexts)"""
_TOKS = f"toks AS (SELECT DISTINCT answer_id, sentence_no, unnest({_digits('sentence')}) AS t FROM roles)"
_MISS = "miss AS (SELECT answer_id, sentence_no, t FROM toks WHERE NOT EXISTS (SELECT 1 FROM alld WHERE alld.answer_id = toks.answer_id AND contains(d, t)))"


@query("unsupported_digits", f"WITH {_ROLES}, {_CTXD}, {_TOKS}, {_MISS} SELECT answer_id, sentence_no, t AS token FROM miss")
def _(spark, sf):
    return audit.unsupported_digits(_rows(spark, sf), contexts(spark, sf))


_GRADED = f"""{_ROLES}, {_CTXD}, {_TOKS}, {_MISS}, graded AS (SELECT answer_id, sentence_no, sentence, len({_digits('sentence')}) > 0
 AND (answer_id, sentence_no) NOT IN (SELECT (answer_id, sentence_no) FROM miss) AS supported FROM roles
 WHERE role IN ('affirmation', 'citation') AND length(sentence) >= 20 AND regexp_matches(sentence, '\\d'))"""


@query("ground_answers", f"WITH {_GRADED} SELECT answer_id, sentence_no, supported FROM graded")
def _(spark, sf):
    return audit.ground_answers(_roles(spark, sf, sources := contexts(spark, sf)), sources).select("answer_id", "sentence_no", "supported")


@query(
    "grounding_summary",
    f"""WITH {_GRADED} SELECT a.answer_id, count(g.answer_id) AS checked, count(*) FILTER (WHERE NOT supported) AS unsupported,
 CASE WHEN count(g.answer_id) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS grounding_score FROM answers a LEFT JOIN graded g USING (answer_id) GROUP BY a.answer_id""",
)
def _(spark, sf):
    graded = audit.ground_answers(_roles(spark, sf, sources := contexts(spark, sf)), sources)
    return audit.grounding_summary(answers(spark, sf), graded, sources).select("answer_id", "checked", "unsupported", "grounding_score")


_ATTR = """claim AS (SELECT answer_id, sentence_no, cited, n FROM roles JOIN (SELECT answer_id, sentence_no, count(*) AS n FROM toks GROUP BY ALL) USING (answer_id, sentence_no) WHERE role = 'citation'),
 sup AS (SELECT DISTINCT answer_id, sentence_no, t, path FROM toks JOIN ctxd USING (answer_id) WHERE contains(d, t)),
 own AS (SELECT answer_id, sentence_no FROM claim JOIN sup USING (answer_id, sentence_no) WHERE list_contains(cited, path) GROUP BY ALL HAVING count(DISTINCT t) = max(n)),
 oth AS (SELECT answer_id, sentence_no, path FROM claim JOIN sup USING (answer_id, sentence_no) WHERE NOT list_contains(cited, path) GROUP BY ALL HAVING count(DISTINCT t) = max(n))"""


@query(
    "attribute_digits",
    f"""WITH {_ROLES}, {_CTXD}, {_TOKS}, {_ATTR} SELECT answer_id, sentence_no, split_part(min(path), '/', -1) AS probable_source FROM oth
 WHERE (answer_id, sentence_no) NOT IN (SELECT (answer_id, sentence_no) FROM own) GROUP BY answer_id, sentence_no HAVING count(*) = 1""",
)
def _(spark, sf):
    return audit.attribute_digits(_roles(spark, sf, sources := contexts(spark, sf)), sources)


@query(
    "stale_citations",
    f"""WITH {ANSWERS}, {_SPLIT}, {_FAB}, {_CTXD}, st AS (SELECT answer_id, sentence_no, replace(lower(sentence), lower(candidate), ' ') AS s FROM sents JOIN fab USING (answer_id)
 WHERE contains(lower(sentence), lower(candidate))), tk AS (SELECT DISTINCT answer_id, sentence_no, unnest({_digits('s')}) AS t FROM st),
 n AS (SELECT answer_id, sentence_no, count(*) AS n FROM tk GROUP BY ALL), f AS (SELECT answer_id, sentence_no, path FROM tk JOIN ctxd USING (answer_id) JOIN n USING (answer_id, sentence_no)
 WHERE contains(d, t) GROUP BY answer_id, sentence_no, path HAVING count(DISTINCT t) = max(n))
 SELECT answer_id, sentence_no, split_part(min(path), '/', -1) AS probable_source FROM f GROUP BY answer_id, sentence_no HAVING count(*) = 1""",
)
def _(spark, sf):
    sources = contexts(spark, sf)
    return audit.stale_citations(_rows(spark, sf), audit.fabricated_citations(answers(spark, sf), sources), sources)


def _vectors(rows, sources, wanted):
    """Hashed vectors of the ``wanted`` sentences and of their answers' sources, fitted on all sentences and sources so they compare."""
    texts = rows.select(F.col("sentence").alias("t")).unionAll(sources.select(F.col("content").alias("t")))
    asked = wanted.select("answer_id", "sentence_no", F.lit(None).cast("string").alias("path"), F.col("sentence").alias("t"))
    docs = sources.join(asked.select("answer_id").distinct(), "answer_id", "left_semi")
    docs = docs.select("answer_id", F.lit(None).cast("int").alias("sentence_no"), "path", F.col("content").alias("t"))
    both = embed_hashed(asked.unionByName(docs), "t", size=64, fitted_on=texts)
    return both.where("path IS NULL").drop("path"), both.where("path IS NOT NULL").drop("sentence_no")


def _audited(spark, sf):
    """Sources and sentences with their roles, each worked out once."""
    sources = contexts(spark, sf)
    return sources, _roles(spark, sf, sources)


@query("attribute_embedding")
def _(spark, sf):
    sources, roles = _audited(spark, sf)
    wanted = roles.where((F.col("role") == "citation") & (F.size(digit_tokens(F.col("sentence"))) == 0))
    return audit.attribute_embedding(roles, *_vectors(roles, sources, wanted))


@query("ground_with_similarity")
def _(spark, sf):
    """Claims without digits are graded by their closest source."""
    sources, roles = _audited(spark, sf)
    best = audit.best_similarity(*_vectors(roles, sources, audit.wordy_claims(roles)))
    return audit.ground_answers(roles, sources, best).select("answer_id", "sentence_no", "supported")


_FILED = """asks AS (SELECT o_orderkey AS answer_id, o_orderpriority || '-2024' AS token FROM orders),
 c AS (SELECT l_orderkey AS answer_id, '/l/' || l_linenumber || '/' || l_partkey AS path, CASE l_returnflag WHEN 'R' THEN '1-URGENT-2024' WHEN 'A' THEN '2-HIGH-2024' ELSE '3-MEDIUM-2024' END AS content FROM lineitem),
 several AS (SELECT answer_id, token, count(DISTINCT path) AS sources FROM asks JOIN c USING (answer_id) WHERE contains(lower(content), lower(token)) AND token NOT LIKE '4-%' GROUP BY ALL HAVING count(DISTINCT path) >= 2)"""


def _filed(spark, sf):
    asks = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("answer_id"),
        F.concat(F.lit("Where is «"), "o_orderpriority", F.lit("-2024» filed?")).alias("question"),
    )
    content = F.when(F.col("l_returnflag") == "R", "1-URGENT-2024").when(F.col("l_returnflag") == "A", "2-HIGH-2024").otherwise("3-MEDIUM-2024")
    sources = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("answer_id"), F.concat(F.lit("/l/"), "l_linenumber", F.lit("/"), "l_partkey").alias("path"),
        F.lit("").alias("title"), content.alias("content"),
    )
    return asks, sources


@query("multi_source_token", f"WITH {_FILED} SELECT * FROM several")
def _(spark, sf):
    return audit.multi_source_token(*_filed(spark, sf))


@query(
    "multi_source_notice",
    f"""WITH {_FILED}, total AS (SELECT content AS token, count(DISTINCT path) AS bearers FROM c GROUP BY content),
 listed AS (SELECT answer_id, token, list_sort(list(DISTINCT path)) AS l FROM several JOIN c USING (answer_id) WHERE contains(lower(content), lower(token)) GROUP BY ALL)
 SELECT answer_id, chr(10) || chr(10) || '📎 Cette information apparaît dans ' || CASE WHEN bearers > len(l) THEN 'au moins ' || bearers || ' documents (les ' || len(l) || ' plus pertinents) :' ELSE len(l) || ' documents :' END
 || chr(10) || array_to_string(list_transform(l, lambda p: '• ' || p), chr(10)) AS notice FROM listed JOIN total USING (token)""",
)
def _(spark, sf):
    """The sources of a token that several hold, beside how many documents hold it in all."""
    asks, sources = _filed(spark, sf)
    found = materialise(audit.multi_source_token(asks, sources), "several-sources")
    held = sources.join(found.select("answer_id", "token"), "answer_id").where(F.contains(F.lower("content"), F.lower("token")))
    total = sources.groupBy(F.col("content").alias("token")).agg(F.count_distinct("path").alias("bearers"))
    return audit.multi_source_notice(found, held.select("answer_id", F.col("path").alias("label")), total)


# --- model verdicts -----------------------------------------------------------------------------------

_RESP = """resp AS (SELECT o_orderkey AS response_id, CASE o_orderstatus WHEN 'O' THEN 'supported' WHEN 'P' THEN 'contradicted' ELSE 'absent' END AS a,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'CONTRADICTED' ELSE 'SUPPORTED' END AS b FROM orders)"""


def _responses(spark, sf):
    a = F.when(F.col("o_orderstatus") == "O", "supported").when(F.col("o_orderstatus") == "P", "contradicted").otherwise("absent")
    b = F.when(F.col("o_orderpriority") == "1-URGENT", "CONTRADICTED").otherwise("SUPPORTED")
    text = F.concat(
        F.lit("<think>1: CONTRADICTED maybe</think>\n1: ABSENT\n<1>: "), a, F.lit("\n2) "), b, F.lit("\n9: ABSENT"),
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("response_id"), F.lit(3).alias("n_claims"), text.alias("response"))


@query(
    "parse_verdicts",
    f"WITH {_RESP} SELECT response_id, unnest([1, 2, 3]) AS claim_no, unnest([a, lower(b), 'supported']) AS verdict FROM resp",
)
def _(spark, sf):
    return audit.parse_verdicts(_responses(spark, sf))


@query(
    "parse_appeals",
    """SELECT o_orderkey AS response_id, unnest([1, 2]) AS claim_no, unnest([CASE o_orderstatus WHEN 'O' THEN 'affirmation' ELSE 'habillage_echo' END, 'affirmation']) AS verdict FROM orders""",
)
def _(spark, sf):
    label = F.when(F.col("o_orderstatus") == "O", "AFFIRMATION").when(F.col("o_orderstatus") == "P", "HABILLAGE_ECHO").otherwise("echo")
    responses = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("response_id"), F.lit(2).alias("n_claims"), F.concat(F.lit("1 - "), label, F.lit("\n2 unsure")).alias("response")
    )
    return audit.parse_appeals(responses)


@query(
    "apply_appeal",
    f"WITH {_GRADED} SELECT answer_id, sentence_no FROM graded WHERE NOT supported AND answer_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
)
def _(spark, sf):
    graded = audit.ground_answers(_roles(spark, sf, sources := contexts(spark, sf)), sources)
    flags = materialise(graded.where("not supported").select("answer_id", "sentence_no"), "flags")  # read twice
    cleared = flags.join(table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("answer_id")), "answer_id", "left_semi")
    return audit.apply_appeal(flags, cleared.withColumn("verdict", F.lit("habillage_echo")))


@query("parse_route", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'general' ELSE 'documentary' END AS route FROM orders")
def _(spark, sf):
    said = F.when(F.col("o_orderstatus") == "O", "General.").when(F.col("o_orderstatus") == "P", "DOCUMENTARY").otherwise("no idea")
    return table(spark, sf, "orders").select("o_orderkey", audit.parse_route(said).alias("route"))


@query(
    "grounding_notice",
    f"""WITH {_GRADED}, u AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY sentence_no) AS r, count(*) OVER (PARTITION BY answer_id) AS n FROM graded WHERE NOT supported)
 SELECT answer_id, chr(10) || chr(10) || '⚠️ Fiabilité : ' || CASE WHEN n = 1 THEN '1 détail chiffré de cette réponse n''a pas été retrouvé' ELSE n || ' détails chiffrés de cette réponse n''ont pas été retrouvés' END
 || ' dans vos documents — vérifiez ces points dans les sources :' || chr(10) || string_agg('• « ' || CASE WHEN length(sentence) <= 120 THEN sentence ELSE rtrim(left(sentence, 119)) || '…' END || ' »', chr(10) ORDER BY r) FILTER (WHERE r <= 3)
 || CASE WHEN n > 4 THEN chr(10) || '…et ' || (n - 3) || ' autres.' WHEN n = 4 THEN chr(10) || '…et 1 autre.' ELSE '' END AS notice FROM u GROUP BY answer_id, n""",
)
def _(spark, sf):
    return audit.grounding_notice(audit.ground_answers(_roles(spark, sf, sources := contexts(spark, sf)), sources))


@query(
    "citation_notice",
    f"""WITH {ANSWERS}, {_FAB} SELECT answer_id, chr(10) || chr(10) || '⚠️ Avertissement : la réponse ci-dessus cite une source introuvable dans vos documents indexés : « ' || candidate
 || ' ». Ne vous fiez pas à cette référence.' AS notice FROM fab""",
)
def _(spark, sf):
    return audit.citation_notice(audit.fabricated_citations(answers(spark, sf), contexts(spark, sf)))


@query(
    "deleted_notice",
    f"""WITH {ANSWERS}, {_TRASHED}, d AS (SELECT DISTINCT c.answer_id, split_part(c.path, '/', -1) AS name FROM contexts c JOIN trash USING (path)
 JOIN answers a ON a.answer_id = c.answer_id WHERE contains(lower(text), c.title))
 SELECT answer_id, chr(10) || chr(10) || 'ℹ️ Note : le' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END || ' fichier' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END || ' ' || string_agg('« ' || name || ' »', ', ' ORDER BY name)
 || CASE WHEN count(*) > 1 THEN ' n''existent' ELSE ' n''existe' END || ' plus sur le disque (supprimé' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END || ', en attente de purge de l''index).' AS notice FROM d GROUP BY answer_id""",
)
def _(spark, sf):
    gone = table(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr(
        "'/orders/' || l_orderkey || '/line-' || l_linenumber || '.md' AS path"
    )
    return audit.deleted_notice(audit.deleted_citations(answers(spark, sf), contexts(spark, sf), gone))


@query("attribution_notice")
def _(spark, sf):
    sources = contexts(spark, sf)
    roles = _roles(spark, sf, sources)
    flags = audit.attribute_digits(roles, sources).join(roles.select("answer_id", "sentence_no", "sentence", "cited"), ["answer_id", "sentence_no"])
    return audit.attribution_notice(flags.withColumns({"attributed": F.array_join("cited", ", "), "stale": F.lit(False)}))


@query(
    "contradiction_notice",
    f"""WITH {_RESP}, c AS (SELECT response_id, CASE WHEN a = 'contradicted' THEN 1 ELSE 0 END + CASE WHEN b = 'CONTRADICTED' THEN 1 ELSE 0 END AS n,
 concat_ws(chr(10), CASE WHEN a = 'contradicted' THEN '• « claim 1 of ' || response_id || ' »' END, CASE WHEN b = 'CONTRADICTED' THEN '• « claim 2 of ' || response_id || ' »' END) AS bullets FROM resp)
 SELECT response_id, chr(10) || chr(10) || '⛔ Vérification approfondie : ' || CASE n WHEN 1 THEN '1 affirmation ci-dessus semble contredite' ELSE '2 affirmations ci-dessus semblent contredites' END
 || ' par vos documents — à corriger en priorité :' || chr(10) || bullets AS notice FROM c WHERE n > 0""",
)
def _(spark, sf):
    claim = F.concat(F.lit("claim "), "claim_no", F.lit(" of "), "response_id")
    return audit.contradiction_notice(audit.parse_verdicts(_responses(spark, sf)).withColumn("claim", claim))
