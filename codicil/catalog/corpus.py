"""Corpus preparation: readers, projections, text rules, chunking, writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from codicil.catalog.base import query
from codicil.catalog.tables import CORPUS, FILES, corpus, files, table
from codicil.functions import paths, text
from codicil.functions import unicode as uc
from codicil.operators import chunks as ch
from codicil.session import work_folder
from codicil.sources import readers, sinks

CJK_FROM, CJK_TO = "abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄"
CYRILLIC_FROM, CYRILLIC_TO = "aeo", "аео"


# --- sources and sinks --------------------------------------------------------------------


@query("hash_content", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, sf):
    return readers.hash_content(table(spark, sf, "documents"), "text").select("doc_id", "sha256")


@query(
    "text_counts",
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS word_count,
 length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents""",
)
def _(spark, sf):
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.word_count(body).alias("word_count"), text.line_count(body).alias("line_count")
    )


@query(
    "code_files",
    """SELECT o_orderstatus AS folder, 'csv' AS programming_language, 'utf-8' AS encoding, count(*) AS lines, count(*) AS words,
 CAST(sum(length(o_orderkey::VARCHAR) + length(o_custkey::VARCHAR) + 2) AS BIGINT) AS characters FROM orders GROUP BY o_orderstatus""",
)
def _(spark, sf):
    """Orders written as CSV files by Spark, a folder for each status, and read as source files."""
    folder = work_folder(spark, "code")
    table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_custkey").write.partitionBy("o_orderstatus").csv(folder)
    found = readers.read_code_files(spark, folder)
    return found.groupBy(F.regexp_extract("path", "o_orderstatus=([^/]+)", 1).alias("folder"), "programming_language", "encoding").agg(
        F.sum(F.col("line_count") - 1).alias("lines"), F.sum("word_count").alias("words"), F.sum(F.length("text")).alias("characters")
    )


@query(
    "json_docs",
    """SELECT event_id, len(json_keys(props)) AS keys_count, 2 + 2 * len(json_keys(props)) AS word_count,
 CAST(NULL AS VARCHAR) AS error FROM events""",
)
def _(spark, sf):
    return readers.parse_json(table(spark, sf, "events").select("event_id", "props"), "props").select(
        "event_id", "keys_count", "word_count", "error"
    )


@query(
    "route_by_extension",
    r"""WITH p AS (SELECT page_id, lower(regexp_extract(split_part(url, '/', -1), '[^.].*?(\.[^.]+)$', 1)) AS ext,
 length(html) / 1000.0 AS size_mb FROM pages)
 SELECT page_id, CASE WHEN size_mb > 50 THEN NULL WHEN ext = '.json' THEN 'json' WHEN ext IN ('.html', '.htm') THEN 'code' END AS route,
 CASE WHEN size_mb > 50 THEN 'too large' WHEN ext IN ('.json', '.html', '.htm') THEN NULL
 ELSE 'Unsupported file type: ' || ext END AS error FROM p""",
)
def _(spark, sf):
    # Page sizes are read as megabytes so that the size limit has something to reject.
    found = table(spark, sf, "pages").select(
        "page_id", paths.route(F.col("url"), F.length("html") / F.lit(1000.0)).alias("r")
    )
    error = F.when(F.startswith("r.error", F.lit("File too large")), "too large").otherwise(F.col("r.error"))
    return found.select("page_id", "r.route", error.alias("error"))


@query(
    "latest_per_key",
    """SELECT user_id, event_id, event_type, value FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    return sinks.latest_per_key(events, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query(
    "upsert_documents",
    """WITH batch AS (SELECT o_custkey AS id, o_orderpriority AS content FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
 SELECT id, content, true AS has_content FROM batch UNION ALL
 SELECT c_custkey, c_name, true FROM customer WHERE c_custkey NOT IN (SELECT id FROM batch)""",
)
def _(spark, sf):
    recent = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp"))
    recent = recent.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    batch = sinks.latest_per_key(recent, "o_custkey", "o_orderdate", "o_orderkey").select(
        F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("content")
    )
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("content"))
    out = sinks.upsert_documents(sinks.prepare_documents(target), sinks.prepare_documents(batch))
    return out.select("id", "content", "has_content")


_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(160))"""


def _windows(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT doc_id, i::INT AS chunk_index, n::INT AS total_chunks, substring(t, i * {step} + 1, {size}) AS content,
 (i * {step})::INT AS offset_start, least(i * {step} + {size}, length(t))::INT AS offset_end,
 doc_id || '_' || lpad(i::VARCHAR, 5, '0') AS chunk_id
 FROM (SELECT doc_id, t, n, unnest(range(n)) AS i FROM (SELECT doc_id, t,
 greatest(1, ceil((length(t) - {overlap}) / {step}))::BIGINT AS n FROM normed WHERE t <> ''))"""


_NORMED = f"normed AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents)"


@query("fixed_windows", f"WITH {_NORMED} {_windows(1536, 150)}")
def _(spark, sf):
    return ch.fixed_windows(corpus(spark, sf))


@query(
    "replace_chunks",
    f"""WITH {_NORMED}, old AS ({_windows(1536, 150)}), fresh AS ({_windows(768, 75)}),
 ids AS (SELECT doc_id FROM labels WHERE quality = 0)
 SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM ids)
 UNION ALL SELECT * FROM fresh WHERE doc_id IN (SELECT doc_id FROM ids)""",
)
def _(spark, sf):
    docs = corpus(spark, sf)
    ids = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    fresh = ch.fixed_windows(docs.join(ids, "doc_id", "left_semi"), chunk_tokens=256, overlap_tokens=25)
    return sinks.replace_chunks(ch.fixed_windows(docs), ids, fresh)


@query(
    "delete_documents",
    f"""WITH {_NORMED}, c AS ({_windows(1536, 150)}) SELECT doc_id, count(*) AS n_chunks FROM c
 WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id""",
)
def _(spark, sf):
    docs = corpus(spark, sf)
    ids = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    _, left = sinks.delete_documents(docs, ch.fixed_windows(docs), ids)
    return ch.chunk_counts(left)


@query("read_vectors", "SELECT vec_id, len(embedding)::INT AS dims FROM embeddings WHERE embedding IS NOT NULL")
def _(spark, sf):
    found = readers.read_vectors(spark, f"{sf}/embeddings.parquet", "vec_id long, embedding array<float>", "embedding")
    return found.select("vec_id", F.size("embedding").alias("dims"))


@query("list_documents", f"WITH {CORPUS} SELECT doc_id, path FROM corpus")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", "path")


@query(
    "ingest_results_in_order",
    f"""WITH {CORPUS} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, path, trim(content) <> '' AS success FROM corpus""",
)
def _(spark, sf):
    # doc_id is dense from zero, so it is the position in the request
    rows = corpus(spark, sf).select(F.col("doc_id").alias("pos"), "path", (~text.is_blank(F.col("content"))).alias("success"))
    return sinks.with_positions(rows)


# --- projections ---------------------------------------------------------------------------


@query("doc_id", f"WITH {CORPUS} SELECT doc_id, sha256(nfc_normalize(path)) AS id FROM corpus")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", paths.doc_id(F.col("path")).alias("id"))


@query(
    "path_parts",
    r"""WITH p AS (SELECT page_id, url, split_part(url, '/', -1) AS name FROM pages), e AS (SELECT *,
 regexp_extract(name, '[^.].*?(\.[^.]+)$', 1) AS suffix FROM p)
 SELECT page_id, left(name, length(name) - length(suffix)) AS title, lower(suffix) AS file_type,
 left(url, length(url) - length(name) - 1) AS parent FROM e""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.path_parts(F.col("url")).alias("p")).select("page_id", "p.*")


@query(
    "category_of_files",
    f"""WITH {FILES} SELECT category, count(*) AS n FROM (SELECT CASE regexp_extract(path, '\\.[a-z]+$')
 WHEN '.txt' THEN 'text' WHEN '.pdf' THEN 'document' WHEN '.docx' THEN 'document' WHEN '.py' THEN 'code' ELSE 'other' END AS category
 FROM files) GROUP BY category""",
)
def _(spark, sf):
    kinds = files(spark, sf).select(paths.category(paths.extension(F.col("path"))).alias("category"))
    return kinds.groupBy("category").agg(F.count("*").alias("n"))


def _notations(df):
    lang = F.col("lang")
    raw = F.array(
        F.concat(lang, F.lit("-"), F.upper(lang)), F.concat(F.upper(lang), F.lit("_x")), F.concat(lang, F.lit("+"), lang),
        F.concat(lang, F.lit("+en")), F.col("source"),
    )
    return df.select("doc_id", F.posexplode(raw).alias("form", "raw"))


_FORMS = """forms AS (SELECT doc_id, lang, source, unnest([0, 1, 2, 3, 4]) AS form FROM documents)"""


@query(
    "language_tag",
    f"""WITH {_FORMS} SELECT doc_id, form::INT AS form, CASE WHEN form < 3 THEN lang WHEN form = 3 AND lang = 'en' THEN 'en'
 ELSE 'unknown' END AS tag FROM forms""",
)
def _(spark, sf):
    return _notations(table(spark, sf, "documents")).select("doc_id", "form", text.language_tag(F.col("raw")).alias("tag"))


@query(
    "language_filter_value",
    f"""WITH {_FORMS} SELECT doc_id, form::INT AS form, CASE WHEN form < 3 THEN lang WHEN form = 3 THEN CASE WHEN lang = 'en' THEN 'en'
 ELSE lang || '+en' END ELSE lower(source) END AS value FROM forms""",
)
def _(spark, sf):
    return _notations(table(spark, sf, "documents")).select(
        "doc_id", "form", text.language_filter_value(F.col("raw")).alias("value")
    )


@query("normalize_text", f"SELECT doc_id, {_NORM.format('text')} AS normalized FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


_HAN = f"translate(lower(text), '{CJK_FROM}', '{CJK_TO}')"
_CJK_CLASS = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"


@query(
    "glue_cjk_line",
    rf"""SELECT doc_id, regexp_replace(regexp_replace({_HAN}, '({_CJK_CLASS})[ \t]+({_CJK_CLASS})', '\1\2', 'g'),
 '({_CJK_CLASS})[ \t]+({_CJK_CLASS})', '\1\2', 'g') AS glued FROM documents""",
)
def _(spark, sf):
    han = F.translate(F.lower("text"), CJK_FROM, CJK_TO)
    return table(spark, sf, "documents").select("doc_id", text.glue_cjk_line(han).alias("glued"))


@query(
    "glue_cjk_columns",
    f"""SELECT p_partkey, list_aggregate(list_transform(string_split(translate(p_name, '{CJK_FROM}', '{CJK_TO}'), ' '),
 lambda w: CASE WHEN length(w) >= 3 THEN w ELSE array_to_string(string_split(w, ''), chr(10)) END), 'string_agg', chr(10) || ' ' || chr(10)) AS glued
 FROM part""",
)
def _(spark, sf):
    # One letter per line turns each word into a column; the space stays a line of its own.
    han = F.translate("p_name", CJK_FROM, CJK_TO)
    column = F.array_join(F.split(han, ""), "\n")
    return table(spark, sf, "part").select("p_partkey", text.glue_cjk_columns(column).alias("glued"))


_MIXED = f"translate(text, '{CYRILLIC_FROM}', '{CYRILLIC_TO}')"
_LETTERS = rf"letters AS (SELECT doc_id, regexp_replace({_MIXED}, '[^\p{{L}}]', '', 'g') AS s FROM documents)"
_FOREIGN = r"length(regexp_replace(s, '[^\p{Cyrillic}]', '', 'g'))"


@query(
    "script_ratio",
    f"""WITH {_LETTERS} SELECT doc_id, round(CASE WHEN length(s) = 0 THEN 0 ELSE {_FOREIGN} / length(s) END, 6) AS ratio,
 length(s) AS letters FROM letters""",
)
def _(spark, sf):
    mixed = F.translate("text", CYRILLIC_FROM, CYRILLIC_TO)
    found = table(spark, sf, "documents").select("doc_id", text.script_ratio(mixed, ["LATIN"]).alias("r"))
    return found.select("doc_id", F.round("r.ratio", 6).alias("ratio"), "r.letters")


@query("missing_script", f"WITH {_LETTERS} SELECT doc_id, {_FOREIGN} = 0 AS missing FROM letters")
def _(spark, sf):
    mixed = F.translate("text", CYRILLIC_FROM, CYRILLIC_TO)
    return table(spark, sf, "documents").select("doc_id", text.missing_script(mixed, ["CYRILLIC"]).alias("missing"))


@query("is_garbled", f"WITH {_LETTERS} SELECT doc_id, length(s) >= 200 AND {_FOREIGN} / length(s) >= 0.20 AS garbled FROM letters")
def _(spark, sf):
    mixed = F.translate("text", CYRILLIC_FROM, CYRILLIC_TO)
    return table(spark, sf, "documents").select("doc_id", text.is_garbled(mixed, ["fr", "en"]).alias("garbled"))


@query("token_estimate", "SELECT doc_id, length(text) // 3 AS chunk_tokens, length(text) // 4 AS context_tokens FROM documents")
def _(spark, sf):
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.token_estimate(body, 3).alias("chunk_tokens"), text.token_estimate(body, 4).alias("context_tokens")
    )


@query(
    "result_summary",
    f"""WITH {CORPUS} SELECT doc_id, CASE WHEN length(content) > 500 THEN left(content, 500) || '...' ELSE content END AS summary,
 CASE WHEN language = 'en' THEN split_part(path, '/', -1) ELSE title END AS title, round(n_chars / 7.0, 4) AS score FROM corpus""",
)
def _(spark, sf):
    # English rows lose their title, so they fall back to the last path part.
    title = F.when(F.col("language") != "en", F.col("title"))
    return corpus(spark, sf).select(
        "doc_id", text.summary(F.col("content")).alias("summary"),
        text.title_or_last_part(title, F.col("path")).alias("title"), F.round(F.col("n_chars") / F.lit(7.0), 4).alias("score"),
    )


@query(
    "content_fingerprint",
    "SELECT doc_id, sha256(trim(replace(nfc_normalize(text), '…', '...'), ' ' || chr(9) || chr(10) || chr(13))) AS fingerprint FROM documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_fingerprint(F.col("text")).alias("fingerprint"))


@query(
    "excerpt_around",
    """WITH t AS (SELECT doc_id, replace(text, '…', '...') AS body, regexp_extract(lower(text), '[a-z]{8,}') AS token FROM documents),
 h AS (SELECT *, instr(lower(body), token) - 1 AS hit FROM t WHERE token <> ''),
 b AS (SELECT *, greatest(0, hit - 200) AS s, least(length(body), hit + length(token) + 200) AS e FROM h)
 SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || substring(body, s + 1, e - s) || CASE WHEN e < length(body) THEN '…' ELSE '' END AS excerpt FROM b""",
)
def _(spark, sf):
    token = F.regexp_extract(F.lower("text"), "[a-z]{8,}", 0)
    rows = table(spark, sf, "documents").select("doc_id", "text", token.alias("token")).where("token <> ''")
    return rows.select("doc_id", text.excerpt_around(F.col("text"), F.col("token")).alias("excerpt"))


@query(
    "normalise_date_column",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS full_stamp, strftime(o_orderdate, '%Y-%m-%d') AS day_stamp,
 o_orderstatus AS kept FROM orders""",
)
def _(spark, sf):
    stamp = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"))
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, sf, "orders").select(
        "o_orderkey", text.normalise_date(stamp).alias("full_stamp"), text.normalise_date(day).alias("day_stamp"),
        text.normalise_date(F.col("o_orderstatus")).alias("kept"),
    )


@query(
    "flatten_metadata",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS type FROM events",
)
def _(spark, sf):
    metadata = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(F.lit("type"), F.col("event_type"), F.lit("path"), F.lit("ignored")),
    )
    rows = table(spark, sf, "events").select("event_id", text.flatten_metadata(metadata, ["id", "path"]).alias("m"))
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["type"].alias("type"))


@query(
    "context_line",
    f"""WITH {CORPUS} SELECT doc_id, '[' || doc_id || '] ' || title || chr(10) || '    Path: ' || path || chr(10) || '    Category: ' || category
 || chr(10) || '    Content: ' || left(content, 500) AS block FROM corpus""",
)
def _(spark, sf):
    from codicil.operators.context import context_line

    return corpus(spark, sf).select(
        "doc_id",
        context_line(F.col("doc_id"), F.col("title"), F.col("path"), F.col("content"), F.col("category")).alias("block"),
    )


@query(
    "tokens_per_second",
    """SELECT event_id, CASE WHEN k <> 0 AND value <> 0 THEN round(k / (value * 1e9 / 1e9), 2) END AS rate
 FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def _(spark, sf):
    count = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(
        "event_id", text.tokens_per_second(count, F.col("value") * F.lit(1e9)).alias("rate")
    )


@query("flatten_content", "SELECT conv_id, turn, role || ' ' || text AS flat FROM conversations")
def _(spark, sf):
    def part(kind, value):
        return F.struct(F.lit(kind).alias("type"), value.alias("text"))

    parts = F.array(part("text", F.col("role")), part("image_url", F.lit("x")), part("text", F.col("text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.flatten_parts(parts).alias("flat"))


# --- text rules ------------------------------------------------------------------------------

_SENTENCES = r"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INT AS sentence_no, s AS sentence FROM (
 SELECT doc_id, generate_subscripts(parts, 1) AS p, trim(unnest(parts), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS s FROM (SELECT doc_id,
 string_split(regexp_replace(regexp_replace(regexp_replace(text, '([。！？])', '\1' || chr(1), 'g'),
 '([.!?…])[\s\x{a0}]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS parts FROM documents)) WHERE s <> ''"""


@query("sentences", _SENTENCES)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(text.sentences(F.col("text"))).alias("sentence_no", "sentence")
    )


_DIGITS = r"list_transform(regexp_extract_all({0}, '\d{{1,3}}(?:[\s.,]\d{{3}})+|\d+[.,]\d+|\d+'), lambda t: regexp_replace(t, '\D', '', 'g'))"


@query("digit_tokens", f"SELECT doc_id, array_to_string({_DIGITS.format('text')}, ' ') AS digits FROM documents")
def _(spark, sf):
    from codicil.functions.answers import digit_tokens

    return table(spark, sf, "documents").select("doc_id", F.array_join(digit_tokens(F.col("text")), " ").alias("digits"))


@query(
    "word_shingles",
    r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM benchmark)
 SELECT item_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)""",
)
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.explode(text.word_shingles(F.col("text"), 5)).alias("shingle"))


@query("chunk_documents")
def _(spark, sf):
    return ch.chunk_documents(corpus(spark, sf)).select(
        "chunk_id", "doc_id", "chunk_index", "total_chunks", "content", "offset_start", "offset_end"
    )


@query("rechunk")
def _(spark, sf):
    docs = corpus(spark, sf)
    return ch.rechunk(docs, ch.fixed_windows(docs))


@query(
    "chunk_counts",
    f"""WITH {_NORMED} SELECT doc_id, greatest(1, ceil((length(t) - 150) / 1386))::BIGINT AS n_chunks FROM normed WHERE t <> ''""",
)
def _(spark, sf):
    return ch.chunk_counts(ch.fixed_windows(corpus(spark, sf)))


@query(
    "chunk_positions",
    f"""WITH {_NORMED}, c AS ({_windows(1536, 150)}) SELECT chunk_id, doc_id, chunk_index, total_chunks FROM c""",
)
def _(spark, sf):
    return ch.fixed_windows(corpus(spark, sf)).select("chunk_id", "doc_id", "chunk_index", "total_chunks")


@query(
    "markdown_headings",
    r"""SELECT page_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(replace(replace(html, '<h1>', chr(10) || '# '), '</h1>', chr(10)),
 '(?m)^#{1,6}\s*([^\n]+)$', 1), lambda h: trim(h)), lambda h: length(h) BETWEEN 4 AND 200))) AS heading FROM pages""",
)
def _(spark, sf):
    # A page's <h1> becomes a Markdown heading, a line of its own.
    marked = F.regexp_replace(F.regexp_replace("html", "<h1>", "\n# "), "</h1>", "\n")
    return table(spark, sf, "pages").select("page_id", F.explode(text.markdown_headings(marked)).alias("heading"))


@query("language_id")
def _(spark, sf):
    from codicil.operators.language import score_languages, train_languages

    # Trained on one half of the documents, by a hash of the id, and scored on the other.
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("_half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    held = docs.where("_half = 1").drop("_half")
    return score_languages(train_languages(docs.where("_half = 0"), "text", "lang"), held, "text").select("doc_id", "lang", "detected")
