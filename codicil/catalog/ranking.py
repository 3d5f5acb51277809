"""Query rewriting and lexical, vector and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.catalog.base import query
from codicil.catalog.tables import CORPUS, LETTER_VECTOR, QUESTIONS, corpus, letter_vector, questions, table
from codicil.functions import queries, text
from codicil.operators import context, retrieval

_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def _bm25(questions_from: str, docs_from: str, key: str, content: str, pre: str = "") -> str:
    return f"""{pre}q AS (SELECT query_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM {questions_from}),
 {pre}dt AS (SELECT {key}, {_TOK.format(content)} AS ts FROM {docs_from}), {pre}st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {pre}dt),
 {pre}tf AS (SELECT {key}, dl, term, count(*) AS tf FROM (SELECT {key}, len(ts) AS dl, unnest(ts) AS term FROM {pre}dt) WHERE term IN (SELECT term FROM {pre}q) GROUP BY ALL),
 {pre}df AS (SELECT term, count(*) AS df FROM {pre}tf GROUP BY term),
 {pre}lex AS (SELECT query_id, {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS matched
 FROM {pre}tf t JOIN {pre}df d USING (term) JOIN {pre}q USING (term), {pre}st GROUP BY query_id, {key})"""


def _top(source: str, key: str, limit: int, extra: str = "") -> str:
    return f"""SELECT query_id, rank::INT AS rank, {key}, score{extra} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank
 FROM {source}) WHERE rank <= {limit}"""


@query("keyword_search", f"WITH {CORPUS}, {QUESTIONS}, {_bm25('questions', 'corpus', 'doc_id', 'content')} {_top('lex', 'doc_id', 10, ', matched')}")
def keyword(spark, sf):
    return retrieval.keyword_search(questions(spark, sf), corpus(spark, sf), key="doc_id")


@query(
    "keyword_search_filtered",
    f"WITH {CORPUS}, {QUESTIONS}, english AS (SELECT * FROM corpus WHERE language = 'en'), {_bm25('questions', 'english', 'doc_id', 'content')} {_top('lex', 'doc_id', 10, ', matched')}",
)
def _(spark, sf):
    return retrieval.keyword_search(questions(spark, sf), corpus(spark, sf).where("language = 'en'"), key="doc_id")


@query("document_frequency", f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOK.format('text')})) AS term FROM documents) GROUP BY term")
def _(spark, sf):
    return retrieval.document_frequency(table(spark, sf, "documents"), "text")


@query(
    "count_matches",
    f"""WITH {QUESTIONS}, q AS (SELECT query_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM questions),
 d AS (SELECT doc_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM documents)
 SELECT query_id, count(DISTINCT doc_id) AS n FROM q JOIN d USING (term) GROUP BY query_id""",
)
def _(spark, sf):
    return retrieval.count_matches(questions(spark, sf), table(spark, sf, "documents"), "doc_id", "text")


# Short product questions over part names: typos come from dropping letters.
_ASKS = """asks AS (SELECT DISTINCT 'q' || n_nationkey AS query_id, replace(lower(p_brand || ' ' || p_name), 'e', '') AS text
 FROM part JOIN nation ON p_size = n_nationkey)"""
_TYPO = f"""{_ASKS}, q0 AS (SELECT query_id, min(text) AS text FROM asks GROUP BY query_id),
 q AS (SELECT query_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM q0),
 a AS (SELECT p_partkey, 0 AS attr, unnest(list_distinct({_TOK.format('p_name')})) AS found FROM part UNION ALL
 SELECT p_partkey, 1, unnest(list_distinct({_TOK.format('p_type')})) FROM part UNION ALL
 SELECT p_partkey, 2, unnest(list_distinct({_TOK.format('p_brand')})) FROM part),
 v AS (SELECT DISTINCT found FROM a), qt AS (SELECT DISTINCT term FROM q),
 sim AS (SELECT term, found, levenshtein(term, found) AS typos FROM qt, v WHERE levenshtein(term, found) <= CASE WHEN length(term) >= 8 THEN 2 WHEN length(term) >= 4 THEN 1 ELSE 0 END),
 m AS (SELECT query_id, p_partkey, term, min(typos) AS typos, min(attr) AS attr FROM q JOIN sim USING (term) JOIN a USING (found) GROUP BY ALL),
 b AS (SELECT query_id, p_partkey, count(*) AS matched, sum(typos)::BIGINT AS typos, min(attr)::INT AS attribute FROM m GROUP BY ALL)"""


@query(
    "ranked_search",
    f"""WITH {_TYPO} SELECT query_id, rank::INT AS rank, p_partkey, matched, typos, attribute FROM (SELECT *, row_number() OVER (PARTITION BY query_id
 ORDER BY matched DESC, typos, attribute, p_partkey) AS rank FROM b) WHERE rank <= 10""",
)
def _(spark, sf):
    parts = table(spark, sf, "part")
    asked = parts.join(table(spark, sf, "nation"), F.col("p_size") == F.col("n_nationkey")).groupBy(
        F.concat(F.lit("q"), "n_nationkey").alias("query_id")
    ).agg(F.min(F.replace(F.lower(F.concat_ws(" ", "p_brand", "p_name")), F.lit("e"), F.lit(""))).alias("text"))
    return retrieval.ranked_search(asked, parts, 10, "p_partkey", ("p_name", "p_type", "p_brand"))


@query(
    "title_search",
    f"""WITH {CORPUS}, asks AS (SELECT label AS query_id, 'find document doc ' || vec_id AS text FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
 {_bm25('asks', 'corpus', 'doc_id', 'title')} {_top('lex', 'doc_id', 5, ', matched')}""",
)
def _(spark, sf):
    firsts = table(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("v"))
    asked = firsts.select(F.col("label").alias("query_id"), F.concat(F.lit("find document doc "), "v").alias("text"))
    return retrieval.title_search(asked, corpus(spark, sf), 5, "doc_id")


# --- vectors: label centroids as queries ------------------------------------------------------

_CENTROIDS = """cen AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM (SELECT label, i, avg(x) AS m FROM (SELECT label,
 unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
 sims AS (SELECT query_id, vec_id, round(list_cosine_similarity(qv, embedding::DOUBLE[]), 6) AS score FROM cen, embeddings)"""


def _centroids(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector")
    )


@query("vector_top_k", f"WITH {_CENTROIDS} {_top('sims', 'vec_id', 10)}")
def _(spark, sf):
    return retrieval.vector_top_k(_centroids(spark, sf), table(spark, sf, "embeddings"), 10, "vec_id", "embedding")


@query("vector_threshold", f"WITH {_CENTROIDS}, kept AS (SELECT * FROM sims WHERE score >= 0.3) {_top('kept', 'vec_id', 5)}")
def _(spark, sf):
    return retrieval.vector_top_k(_centroids(spark, sf), table(spark, sf, "embeddings"), 5, "vec_id", "embedding", min_score=0.3)


# --- hybrid: BM25 and letter-frequency vectors ----------------------------------------------------


def _hybrid(ratio: float, docs: str, key: str, where: str = "true") -> str:
    return f"WITH {CORPUS}, {_PIECES}, {QUESTIONS}, {_mixed(ratio, docs, key, where)} {{top}}"


def _mixed(ratio: float, docs: str, key: str, where: str) -> str:
    return f"""{_bm25('questions', docs, key, 'content')},
 dv AS (SELECT {key}, {LETTER_VECTOR} AS v FROM {docs}), qv AS (SELECT query_id, {LETTER_VECTOR} AS v FROM (SELECT query_id, text AS content FROM questions)),
 sem AS (SELECT query_id, {key}, round(CASE WHEN list_sum(dv.v) = 0 THEN 0 ELSE list_cosine_similarity(dv.v, qv.v) END, 6) AS score FROM dv, qv),
 ln AS (SELECT query_id, {key}, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS s FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM lex WINDOW w AS (PARTITION BY query_id))),
 sn AS (SELECT query_id, {key}, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS s FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM sem WINDOW w AS (PARTITION BY query_id))),
 mix AS (SELECT query_id, {key}, round({ratio} * coalesce(sn.s, 0) + {1 - ratio} * coalesce(ln.s, 0), 4) AS score FROM sn FULL OUTER JOIN ln USING (query_id, {key})),
 kept AS (SELECT * FROM mix WHERE {where})"""


_PIECES = """pieces AS (SELECT doc_id || '_' || lpad((i - 1)::VARCHAR, 5, '0') AS chunk_id, doc_id, parts[i] AS content FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
 FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""


def _vectored(df, content="content"):
    return df.withColumn("vector", letter_vector(content))


@query("hybrid_search", _hybrid(0.5, "corpus", "doc_id").replace("{top}", _top("kept", "doc_id", 10)))
def hybrid(spark, sf):
    asked = questions(spark, sf).withColumn("vector", letter_vector("text"))
    return retrieval.hybrid_search(asked, _vectored(corpus(spark, sf)), 10, key="doc_id")


@query(
    "semantic_search",
    f"""WITH {CORPUS}, {QUESTIONS}, dv AS (SELECT doc_id, {LETTER_VECTOR} AS v FROM corpus), qv AS (SELECT query_id, {LETTER_VECTOR} AS v FROM (SELECT query_id, text AS content FROM questions)),
 sem AS (SELECT query_id, doc_id, round(CASE WHEN list_sum(dv.v) = 0 THEN 0 ELSE list_cosine_similarity(dv.v, qv.v) END, 6) AS s FROM dv, qv),
 kept AS (SELECT query_id, doc_id, round(CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1 END, 4) AS score FROM (SELECT *, min(s) OVER w AS lo, max(s) OVER w AS hi FROM sem WINDOW w AS (PARTITION BY query_id)))
 {_top('kept', 'doc_id', 10)}""",
)
def _(spark, sf):
    asked = questions(spark, sf).withColumn("vector", letter_vector("text"))
    return retrieval.hybrid_search(asked, _vectored(corpus(spark, sf)), 10, key="doc_id", mode="semantic")


@query("chunk_search", _hybrid(0.5, "pieces", "chunk_id", "score >= 0.3").replace("{top}", _top("kept", "chunk_id", 5)))
def _(spark, sf):
    asked = questions(spark, sf).withColumn("vector", letter_vector("text"))
    parts = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    parts = parts.withColumn("chunk_id", F.concat_ws("_", "doc_id", F.lpad(F.col("i").cast("string"), 5, "0")))
    return retrieval.chunk_search(asked, _vectored(parts), 5)


@query("embed_hashed")
def _(spark, sf):
    """Default embedding: each document's unit length and filled dimensions."""
    found = retrieval.embed_hashed(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.size(F.filter("vector", lambda x: x != 0)).alias("filled"),
                        F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


# --- query rewriting ---------------------------------------------------------------------------------


@query(
    "salient_terms",
    rf"""SELECT item_id, array_to_string(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_-]*'), lambda w: length(w) >= 2
 AND strip_accents(lower(w)) NOT IN ({', '.join("'" + w + "'" for w in dict.fromkeys(fv.STOP_WORDS))})), ' ') AS terms FROM benchmark""",
)
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(queries.salient_terms(F.col("text")), " ").alias("terms"))


@query("anchor_terms")
def _(spark, sf):
    from codicil.catalog.corpus import CJK_FROM, CJK_TO

    # Capitalised words become ideograph runs.
    han = F.concat("text", F.lit(" "), F.translate(F.lower("text"), CJK_FROM, CJK_TO))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(queries.anchor_terms(han), " ").alias("terms"))


@query(
    "structured_tokens",
    r"""WITH n AS (SELECT doc_id, replace(replace(text, '…', '...'), chr(160), ' ') AS t FROM documents),
 e AS (SELECT doc_id, regexp_extract_all(t, '[^\s@]+@[^\s@]+\.[^\s@]+') AS a, regexp_replace(t, '[^\s@]+@[^\s@]+\.[^\s@]+', ' ', 'g') AS t FROM n),
 k AS (SELECT doc_id, a, list_filter(list_transform(regexp_extract_all(t, '[«"'']([^«»"'']{2,}?)[»"'']', 1), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '') AS b,
 regexp_replace(t, '[«"''][^«»"'']{2,}?[»"'']', ' ', 'g') AS t FROM e)
 SELECT doc_id, array_to_string(list_concat(a, b), ' | ') AS emails_and_quotes FROM k""",
)
def _(spark, sf):
    # The SQL side covers the e-mail and quotation rules; codes need look-ahead and are tested by brute force.
    glued = queries.glue_query(F.col("text"))
    docs = table(spark, sf, "documents").select("doc_id", glued.alias("t"))
    emails, rest = queries._take(F.col("t"), fv.EMAIL)
    quotes, _ = queries._take(rest, fv.QUOTED, 1)
    return docs.select("doc_id", F.array_join(F.concat(emails, quotes), " | ").alias("emails_and_quotes"))


@query("distinctive_tokens")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.explode(queries.structured_tokens(F.col("text"), min_nonlatin=2)).alias("token")
    )


@query(
    "distill",
    rf"""WITH {QUESTIONS}, w AS (SELECT query_id, text, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT query_id, text, regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{2,}}') AS ws FROM questions)),
 f AS (SELECT query_id, lower(ws[i]) AS term, min(i) AS i, arg_min(ws[i], i) AS word FROM w GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOK.format('text')})) AS term FROM documents) GROUP BY term),
 r AS (SELECT query_id, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT query_id, word, i FROM f LEFT JOIN df USING (term)
 WHERE coalesce(df, 0) < greatest(1, floor(0.15 * (SELECT count(*) FROM documents))))  GROUP BY query_id)
 SELECT query_id, coalesce(t, text) AS text FROM questions LEFT JOIN r USING (query_id)""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    total = docs.agg(F.count("*")).scalar()
    return retrieval.distill(questions(spark, sf), retrieval.document_frequency(docs, "text"), total)


# Each benchmark text is wrapped into question shapes.
_SHAPES = ("Quels documents parlent de {0} ?", "Which files are about {0}?", "Y a-t-il des documents sur {0} ?", "Are there any documents about {0}?",
           "Quels fichiers mentionnent {0}", "Dans quels documents trouve-t-on {0} ?", "Which colour is {0}", "{0}")


@query(
    "reduce_meta_question",
    f"""WITH b AS (SELECT item_id, regexp_replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '[\\s?!.,;:]+$', '') AS x FROM benchmark),
 s AS (SELECT item_id, x, unnest(range(8)) AS form FROM b)
 SELECT item_id, form::INT AS form, CASE WHEN form < 6 THEN x WHEN form = 6 THEN 'Which colour is ' || x ELSE x END AS subject, form < 6 AS matched,
 form = 6 AS near_miss FROM s""",
)
def _(spark, sf):
    body = F.regexp_replace(F.regexp_replace("text", "[\r\n]+", " "), r"[\s?!.,;:]+$", "")
    forms = F.array(*[F.concat(F.lit(s.split("{0}")[0]), F.col("x"), F.lit(s.split("{0}")[1])) for s in _SHAPES])
    asked = table(spark, sf, "benchmark").select("item_id", body.alias("x")).select("item_id", F.posexplode(forms).alias("form", "q"))
    found = asked.select("item_id", "form", queries.reduce_meta_question(F.col("q")).alias("r"))
    return found.select("item_id", "form", "r.subject", "r.matched", "r.near_miss")


_NORMQ = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}_\s\-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("normalize_query", f"SELECT conv_id, turn, {_NORMQ.format('text')} AS normalized FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", queries.normalize_query(F.col("text")).alias("normalized"))


_STOPS = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(fv.EXPANSION_STOP_WORDS + fv.EXPANSION_QUERY_WORDS)) + ")"


@query(
    "content_terms",
    f"SELECT conv_id, turn, array_to_string(list_filter(string_split({_NORMQ.format('text')}, ' '), lambda w: w <> '' AND w NOT IN {_STOPS}), ' ') AS terms FROM conversations",
)
def _(spark, sf):
    terms = queries.content_terms(queries.normalize_query(F.col("text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(terms, " ").alias("terms"))


_KEYS = list(fv.SYNONYMS)
_EXPAND_CASES = " ".join(
    "WHEN {0} THEN [{1}]".format(
        "'" + k.replace("'", "''") + "'",
        ", ".join("'" + w.replace("'", "''") + "'" for w in [k, *[s for s in v if s != k][:3]]),
    )
    for k, v in fv.SYNONYMS.items()
)


@query(
    "expand_terms",
    f"""WITH t AS (SELECT p_partkey, ['cv', lower(p_type), 'facture', p_name, 'email', 'mail'] AS terms FROM part),
 e AS (SELECT p_partkey, flatten(list_transform(terms, lambda t: CASE t {_EXPAND_CASES} ELSE [t] END)) AS x FROM t)
 SELECT p_partkey, array_to_string(list_filter(x, lambda w, i: list_position(x, w) = i), ' ') AS expanded FROM e""",
)
def _(spark, sf):
    terms = F.array(F.lit("cv"), F.lower("p_type"), F.lit("facture"), F.col("p_name"), F.lit("email"), F.lit("mail"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(queries.expand_terms(terms), " ").alias("expanded"))


@query(
    "query_variants",
    """SELECT p_partkey AS query_id, 'my cv ' || p_type AS text FROM part UNION ALL
 SELECT p_partkey, 'my mon ma mes cv curriculum vitae resume résumé ' || lower(p_type) FROM part""",
)
def _(spark, sf):
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("my cv "), "p_type").alias("text"))
    return retrieval.query_variants(asked)


@query(
    "highlight_crop",
    r"""WITH t AS (SELECT doc_id, replace(text, '…', '...') AS body, regexp_extract(lower(text), '[a-z]{10,}') AS token FROM documents),
 h AS (SELECT *, instr(lower(body), token) - 1 AS hit FROM t WHERE token <> ''), b AS (SELECT *, greatest(0, hit - 500) AS s, least(length(body), hit + length(token) + 500) AS e FROM h)
 SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || substring(body, s + 1, e - s) || CASE WHEN e < length(body) THEN '…' ELSE '' END AS excerpt FROM b""",
)
def _(spark, sf):
    token = F.regexp_extract(F.lower("text"), "[a-z]{10,}", 0)
    rows = table(spark, sf, "documents").select("doc_id", "text", token.alias("token")).where("token <> ''")
    return rows.select("doc_id", text.excerpt_around(F.col("text"), F.col("token"), 500).alias("excerpt"))


# --- judging a context ------------------------------------------------------------------------------------

_CTX = "ctx AS (SELECT user_id AS query_id, event_id, event_type AS title, '/e/' || event_type AS path, CASE WHEN value < 30 THEN value / 100 END AS score FROM events)"


def _ctx(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"), "event_id", F.col("event_type").alias("title"),
        F.concat(F.lit("/e/"), "event_type").alias("path"), F.when(F.col("value") < 30, F.col("value") / 100).alias("score"),
    )


@query("all_weak", f"WITH {_CTX} SELECT query_id, bool_and(coalesce(score < 0.55, false)) AS weak, count(*) AS n_context FROM ctx GROUP BY query_id")
def _(spark, sf):
    return context.all_weak(_ctx(spark, sf))


@query(
    "closest_titles",
    f"""WITH {_CTX}, r AS (SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY event_id) AS rank FROM ctx QUALIFY rank <= 3),
 f AS (SELECT query_id, title, min(rank) AS rank FROM r GROUP BY query_id, title)
 SELECT query_id, string_agg(title, ' | ' ORDER BY rank) AS titles FROM f GROUP BY query_id""",
)
def _(spark, sf):
    return context.closest_titles(_ctx(spark, sf).withColumnRenamed("event_id", "rank"))


@query(
    "referent_boost",
    f"""WITH {_CTX}, held AS (SELECT user_id AS query_id, '/e/' || min(event_type) AS path FROM events WHERE event_type <> 'click' GROUP BY user_id)
 SELECT query_id, event_id, CASE WHEN ctx.path = held.path THEN score ELSE 0.0 END AS score FROM ctx JOIN held USING (query_id)""",
)
def _(spark, sf):
    held = table(spark, sf, "events").where("event_type <> 'click'").groupBy(F.col("user_id").alias("query_id")).agg(
        F.concat(F.lit("/e/"), F.min("event_type")).alias("path")
    )
    return context.referent_boost(_ctx(spark, sf), held).select("query_id", "event_id", "score")


_PACK = """p AS (SELECT source AS query_id, doc_id AS rank, text FROM documents), c AS (SELECT *, 51 + sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY rank) AS upto, length(text) // 4 AS cost FROM p)"""


@query(
    "pack_context",
    f"""WITH {_PACK}, m AS (SELECT *, upto > 4000 AND upto - cost <= 4000 AS truncated, 4000 - (upto - cost) - 50 AS room FROM c)
 SELECT query_id, rank, truncated, CASE WHEN truncated AND length(text) > room * 4 THEN left(text, (room * 4)::BIGINT) || '...' ELSE text END AS text
 FROM m WHERE upto <= 4000 OR (truncated AND room > 100)""",
)
def _(spark, sf):
    ranked = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), "text")
    return context.pack_context(ranked, header_tokens=51).select("query_id", "rank", "truncated", "text")


@query("retrieve")
def retrieve_context(spark, sf):
    """The whole retrieval: rewrite, search, anchor, pin, deduplicate, pack."""
    from codicil.plans.retrieve import retrieve

    docs = corpus(spark, sf).select("path", "title", "content")
    return retrieve(questions(spark, sf), docs).select("query_id", "position", "path", "pinned", "truncated")
