"""Change detection, scope, pins and other look-ups expressed as joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from codicil import fixed_values as fv
from codicil.catalog.base import query
from codicil.catalog.tables import (
    CORPUS, FAILURES, FILES, LIVE_ROOTS, QUESTIONS, SNAPSHOTS, TASKS, corpus, failures, files, live_roots, questions,
    snapshots, table, tasks,
)
from codicil.catalog.ranking import _bm25, _top
from codicil.operators import changes, chunks, context, pins
from codicil.operators import tasks as ops
from codicil.operators.posting_index import build_index, indexed_search
from codicil.operators.verbatim import phrase_pairs
from codicil.session import work_folder

_DIFF = f"""{SNAPSHOTS}, diff AS (SELECT coalesce(prev.path, cur.path) AS path, CASE WHEN prev.path IS NULL THEN 'new'
 WHEN cur.path IS NULL THEN 'deleted' WHEN prev.mtime <> cur.mtime THEN 'modified' ELSE 'unchanged' END AS change_type
 FROM prev FULL OUTER JOIN cur ON prev.path = cur.path)"""


@query("snapshot_diff", f"WITH {_DIFF} SELECT path, change_type FROM diff")
def _(spark, sf):
    return changes.snapshot_diff(*snapshots(spark, sf))


@query("scan_summary", f"WITH {_DIFF} SELECT change_type, count(*) AS n FROM diff GROUP BY change_type")
def _(spark, sf):
    return changes.scan_summary(changes.snapshot_diff(*snapshots(spark, sf)))


@query(
    "deleted_under_live_roots",
    f"WITH {_DIFF}, {LIVE_ROOTS} SELECT path, change_type FROM diff WHERE change_type = 'deleted' AND EXISTS "
    "(SELECT 1 FROM roots WHERE path = root OR starts_with(path, root || '/'))",
)
def _(spark, sf):
    return changes.deleted_under_live_roots(changes.snapshot_diff(*snapshots(spark, sf)), live_roots(spark, sf))


_INDEXED = "indexed AS (SELECT DISTINCT doc_id FROM labels)"


@query(
    "reconcile_orphans",
    f"WITH {CORPUS}, {_INDEXED} SELECT doc_id, path FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM indexed)",
)
def _(spark, sf):
    return changes.reconcile_orphans(corpus(spark, sf).select("doc_id", "path"), table(spark, sf, "labels"))


@query(
    "drop_exhausted",
    f"WITH {TASKS}, {FAILURES} SELECT path FROM files WHERE path NOT IN (SELECT path FROM failures WHERE retry_count >= 3)",
)
def _(spark, sf):
    return changes.drop_exhausted(files(spark, sf).select("path"), failures(spark, sf))


@query(
    "to_enqueue",
    f"""WITH {_DIFF}, same AS (SELECT path FROM diff WHERE change_type = 'unchanged' AND path NOT IN (SELECT path FROM files WHERE c_acctbal > 0))
 SELECT path, change_type FROM diff WHERE change_type IN ('new', 'modified') UNION ALL SELECT path, 'reconciled' FROM same""",
)
def _(spark, sf):
    diff = changes.snapshot_diff(*snapshots(spark, sf))
    indexed = files(spark, sf).where("c_acctbal > 0")
    orphans = changes.reconcile_orphans(diff.where("change_type = 'unchanged'"), indexed, "path")
    return changes.to_enqueue(diff, orphans)


@query("out_of_scope", f"WITH {FILES}, {LIVE_ROOTS} SELECT path FROM files WHERE NOT EXISTS (SELECT 1 FROM roots WHERE starts_with(path, root || '/'))")
def _(spark, sf):
    return changes.out_of_scope(files(spark, sf).select("path"), live_roots(spark, sf))


@query("within_roots", f"WITH {FILES}, {LIVE_ROOTS} SELECT path FROM files WHERE EXISTS (SELECT 1 FROM roots WHERE starts_with(path, root || '/'))")
def _(spark, sf):
    return changes.within_roots(files(spark, sf).select("path"), live_roots(spark, sf))


_TRASH = "trash AS (SELECT DISTINCT path FROM corpus JOIN labels USING (doc_id) WHERE toxic = 1)"


@query(
    "flag_deleted",
    f"WITH {CORPUS}, {_TRASH} SELECT doc_id, path, path IN (SELECT path FROM trash) AS deleted FROM corpus",
)
def _(spark, sf):
    docs = corpus(spark, sf).select("doc_id", "path")
    trash = docs.join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi").select("path")
    return changes.flag_deleted(docs, trash).select("doc_id", "path", "deleted")


@query(
    "skip_up_to_date",
    f"""WITH {SNAPSHOTS}, want AS (SELECT cur.path, cur.mtime, c_mktsegment = 'BUILDING' AS force FROM cur JOIN files USING (path))
 SELECT want.path FROM want LEFT JOIN prev ON want.path = prev.path WHERE force OR prev.path IS NULL OR abs(want.mtime - prev.mtime) >= 1e-6""",
)
def _(spark, sf):
    stored, current = snapshots(spark, sf)
    forced = files(spark, sf).select("path", (F.col("c_mktsegment") == "BUILDING").alias("force"))
    return changes.skip_up_to_date(current.join(forced, "path"), stored).select("path")


_WINDOWED = """pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents)"""


@query("chunks_of", f"WITH {_WINDOWED} SELECT doc_id, content FROM pieces WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    pieces = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("content"))
    return changes.chunks_of(pieces, table(spark, sf, "labels").where("quality = 1"))


@query(
    "chunk_with_parent",
    f"WITH {CORPUS}, {_WINDOWED} SELECT p.doc_id, p.content, c.path, c.title FROM pieces p JOIN corpus c ON p.doc_id = c.doc_id",
)
def _(spark, sf):
    pieces = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("content"))
    return pins.chunk_with_parent(pieces, corpus(spark, sf)).select("doc_id", "content", "path", "title")


@query(
    "orphan_chunks",
    f"WITH {_WINDOWED} SELECT doc_id, count(*) AS n FROM pieces WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id",
)
def _(spark, sf):
    pieces = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("content"))
    return chunks.chunk_counts(pins.orphan_chunks(pieces, table(spark, sf, "labels"))).withColumnRenamed("n_chunks", "n")


_HAN = "translate(lower(content), 'aei', '甲乙丙')"
_COPY = f"""{CORPUS}, cjk AS (SELECT doc_id, CASE WHEN language = 'en' THEN {_HAN} ELSE content END AS content FROM corpus),
 vec AS (SELECT vec_id AS doc_id FROM embeddings), classed AS (SELECT cjk.doc_id,
 CASE WHEN regexp_matches(content, '[甲乙丙][ \\t]+[甲乙丙]') THEN 'reindex' ELSE 'copy' END AS population, vec.doc_id IS NOT NULL AS stored,
 l.doc_id IS NOT NULL AS source_exists FROM cjk LEFT JOIN vec ON cjk.doc_id = vec.doc_id LEFT JOIN labels l ON cjk.doc_id = l.doc_id)"""


def _copied(spark, sf):
    # English texts get ideographs, so that some need gluing; labelled documents still have their source.
    han = F.translate(F.lower("content"), "aei", "甲乙丙")
    docs = corpus(spark, sf).select("doc_id", F.when(F.col("language") == "en", han).otherwise(F.col("content")).alias("content"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    present = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("_s"))
    return (
        changes.classify_for_copy(docs, vectors).join(present, "doc_id", "left")
        .withColumn("source_exists", F.coalesce("_s", F.lit(False)))
    )


@query("classify_for_copy", f"WITH {_COPY} SELECT doc_id, population, population = 'copy' AND stored AS has_vector FROM classed")
def _(spark, sf):
    return _copied(spark, sf).select("doc_id", "population", "has_vector")


@query(
    "copy_report",
    f"""WITH {_COPY}, {_WINDOWED} SELECT count(*) AS docs_total, count(*) FILTER (WHERE population = 'copy') AS docs_copied,
 count(*) FILTER (WHERE population = 'copy' AND NOT stored) AS docs_without_vector, count(*) FILTER (WHERE population = 'reindex') AS docs_needing_reindex,
 count(*) FILTER (WHERE population = 'reindex' AND NOT source_exists) AS docs_source_missing, (SELECT count(*) FROM pieces) AS chunks_total,
 (SELECT count(*) FROM pieces WHERE doc_id IN (SELECT doc_id FROM classed WHERE population = 'copy')) AS chunks_copied,
 (SELECT count(*) FROM pieces WHERE doc_id IN (SELECT doc_id FROM classed WHERE population = 'reindex')) AS chunks_excluded FROM classed""",
)
def _(spark, sf):
    pieces = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("content"))
    return changes.copy_report(_copied(spark, sf), pieces)


@query(
    "path_coverage",
    f"""WITH {SNAPSHOTS}, e AS (SELECT path, regexp_extract(path, '\\.[a-z]+$') AS extension, path IN (SELECT path FROM cur) AS done FROM files)
 SELECT extension, count(*) AS eligible, count(*) FILTER (WHERE done) AS indexed, count(*) FILTER (WHERE NOT done) AS remaining FROM e GROUP BY extension""",
)
def _(spark, sf):
    _, indexed = snapshots(spark, sf)
    return changes.path_coverage(files(spark, sf), indexed)


@query("eligible_not_indexed", f"WITH {SNAPSHOTS} SELECT path FROM files EXCEPT SELECT path FROM cur")
def _(spark, sf):
    _, indexed = snapshots(spark, sf)
    return files(spark, sf).select("path").subtract(indexed.select("path"))


@query("eligible_and_indexed", f"WITH {SNAPSHOTS} SELECT path FROM files INTERSECT SELECT path FROM cur")
def _(spark, sf):
    _, indexed = snapshots(spark, sf)
    return files(spark, sf).select("path").intersect(indexed.select("path"))


@query(
    "inflight_dedupe",
    f"""WITH {TASKS} SELECT path AS file_path, lower(c_mktsegment) AS task_type FROM files WHERE NOT EXISTS
 (SELECT 1 FROM tasks t WHERE t.file_path = files.path AND t.task_type = lower(c_mktsegment) AND status = 'pending')""",
)
def _(spark, sf):
    new = files(spark, sf).select(F.col("path").alias("file_path"), F.lower("c_mktsegment").alias("task_type"))
    return changes.inflight_dedupe(new, tasks(spark, sf))


@query(
    "group_by_parent",
    f"""WITH {FILES}, p AS (SELECT regexp_replace(path, '/[^/]*$', '') AS parent, path FROM files)
 SELECT parent, count(*) OVER (PARTITION BY parent) AS n_paths, path FROM p""",
)
def _(spark, sf):
    return changes.group_by_parent(files(spark, sf))


# --- pins: questions built from the corpus's own words ---------------------------------------

# Each labelled document asks for the first long code and the first e-mail of its own text.
_CODES = r"""asks AS (SELECT doc_id AS query_id, 'Where is ' || regexp_extract(text, '[0-9a-f]{16,}') || ' please' AS text FROM documents
 WHERE regexp_extract(text, '[0-9a-f]{16,}') <> '')"""
_CODE_HITS = r"""tok AS (SELECT query_id, regexp_extract(text, '[0-9a-f]{16,}') AS token FROM asks),
 hits AS (SELECT DISTINCT query_id, token, doc_id FROM tok JOIN documents ON contains(lower(documents.text), token))"""


def _asks(spark, sf):
    code = F.regexp_extract("text", "[0-9a-f]{16,}", 0)
    return table(spark, sf, "documents").where(code != "").select(
        F.col("doc_id").alias("query_id"), F.concat(F.lit("Where is "), code, F.lit(" please")).alias("text")
    )


@query(
    "exact_token_pins",
    f"""WITH {_CODES}, {_CODE_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM hits),
 x AS (SELECT r.*, replace(d.text, '…', '...') AS body FROM r JOIN documents d ON r.doc_id = d.doc_id WHERE rank <= 7),
 w AS (SELECT *, greatest(0, instr(lower(body), token) - 1 - 200) AS s, least(length(body), instr(lower(body), token) - 1 + length(token) + 200) AS e FROM x)
 SELECT query_id, rank::INT AS rank, doc_id, token, CASE WHEN s > 0 THEN '…' ELSE '' END || substring(body, s + 1, e - s)
 || CASE WHEN e < length(body) THEN '…' ELSE '' END AS excerpt FROM w""",
)
def _(spark, sf):
    return pins.exact_token_pins(_asks(spark, sf), table(spark, sf, "documents"), key="doc_id", content="text")


@query(
    "token_bearers",
    f"""WITH {_CODES}, {_CODE_HITS} SELECT token, count(DISTINCT hits.doc_id) AS documents, count(DISTINCT trim(d.text)) AS bearers
 FROM hits JOIN documents d ON hits.doc_id = d.doc_id GROUP BY token""",
)
def _(spark, sf):
    return pins.token_bearers(_asks(spark, sf), table(spark, sf, "documents"), key="doc_id", content="text")


_TITLES = """named AS (SELECT doc_id, path, title || ' ' || category || ' notes.txt' AS title FROM corpus),
 asks AS (SELECT doc_id AS query_id, 'please open doc ' || doc_id || ' from ' || category || ' now' AS text FROM corpus),
 qt AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[0-9a-zà-￿]+'))) AS token FROM asks),
 tt AS (SELECT path, list_filter(regexp_extract_all(lower(title), '[0-9a-zà-￿]+'), lambda t: t <> 'txt') AS ts FROM named),
 te AS (SELECT path, len(ts) AS n, unnest(ts) AS token FROM tt),
 cov AS (SELECT query_id, path, count(*) / n AS coverage FROM te JOIN qt ON te.token = qt.token GROUP BY query_id, path, n)"""


@query(
    "title_coverage",
    f"""WITH {CORPUS}, {_TITLES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, path) AS rank FROM cov WHERE coverage >= 0.75)
 SELECT query_id, rank::INT AS rank, path, coverage FROM r WHERE rank <= 5""",
)
def _(spark, sf):
    docs = corpus(spark, sf)
    named = docs.select("path", F.concat("title", F.lit(" "), "category", F.lit(" notes.txt")).alias("title"))
    asks = docs.select(
        F.col("doc_id").alias("query_id"),
        F.concat(F.lit("please open doc "), "doc_id", F.lit(" from "), "category", F.lit(" now")).alias("text"),
    )
    return pins.title_coverage(asks, named, threshold=0.75)


@query(
    "stem_match",
    f"""WITH {CORPUS}, asks AS (SELECT doc_id AS query_id, 'Summarise DOC-' || doc_id || ' and doc-' || (doc_id + 1) AS text FROM corpus)
 SELECT query_id, CASE WHEN d.doc_id = query_id THEN 1 ELSE 2 END::INT AS pos, path FROM asks JOIN corpus d ON d.doc_id IN (query_id, query_id + 1)""",
)
def _(spark, sf):
    asks = corpus(spark, sf).select(
        F.col("doc_id").alias("query_id"),
        F.concat(F.lit("Summarise DOC-"), "doc_id", F.lit(" and doc-"), F.col("doc_id") + 1).alias("text"),
    )
    return pins.stem_match(asks, corpus(spark, sf))


_PHRASES = rf"""{QUESTIONS}, qw AS (SELECT query_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM questions),
 win AS (SELECT query_id, array_to_string(ws[i:i + 4], ' ') AS phrase FROM (SELECT query_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM qw)),
 phrase AS (SELECT DISTINCT query_id, doc_id FROM win JOIN documents d ON contains(lower(d.text), phrase))"""


@query("phrase_match", f"WITH {_PHRASES} SELECT query_id, doc_id FROM phrase")
def _(spark, sf):
    return phrase_pairs(questions(spark, sf), table(spark, sf, "documents"), fv.PHRASE_WORDS, "doc_id", "text")


_PINS = f"""{CORPUS}, {_PHRASES}, pinned AS (SELECT query_id, path, 'phrase' AS source, 1 AS rank FROM phrase JOIN corpus USING (doc_id)
 UNION ALL SELECT item_id, path, 'stem', 1 FROM benchmark JOIN corpus ON item_id = doc_id
 UNION ALL SELECT item_id, path, 'token', 2 FROM benchmark JOIN corpus ON item_id = doc_id OR item_id + 1 = doc_id),
 best AS (SELECT query_id, path, min(CASE source WHEN 'stem' THEN 0 WHEN 'title' THEN 1 WHEN 'token' THEN 2 ELSE 3 END) AS s FROM pinned GROUP BY query_id, path)"""


def _pins(spark, sf):
    docs, asked = corpus(spark, sf), questions(spark, sf)
    paths = docs.select("doc_id", "path")

    def at(pairs, source, rank):
        return pairs.join(paths, "doc_id").select("query_id", "path", F.lit(source).alias("source"), F.lit(rank).alias("rank"))

    phrase = phrase_pairs(asked, table(spark, sf, "documents"), fv.PHRASE_WORDS, "doc_id", "text")
    own = asked.select("query_id", F.col("query_id").alias("doc_id"))
    near = own.unionByName(own.withColumn("doc_id", F.col("doc_id") + 1))
    return at(phrase, "phrase", 1).unionByName(at(own, "stem", 1)).unionByName(at(near, "token", 2))


@query("rank_pins", f"WITH {_PINS} SELECT query_id, path, CASE s WHEN 0 THEN 'stem' WHEN 2 THEN 'token' ELSE 'phrase' END AS source FROM best")
def _(spark, sf):
    return pins.rank_pins(_pins(spark, sf)).select("query_id", "path", "source")


@query(
    "union_pins",
    f"""WITH {_PINS}, r AS (SELECT item_id AS query_id, path FROM benchmark JOIN corpus ON doc_id BETWEEN item_id AND item_id + 3)
 SELECT query_id, path, bool_or(p) AS pinned FROM (SELECT query_id, path, true AS p FROM best UNION ALL SELECT query_id, path, false FROM r) GROUP BY query_id, path""",
)
def _(spark, sf):
    near = questions(spark, sf).select("query_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank"))
    retrieved = near.withColumn("doc_id", F.col("query_id") + F.col("rank")).join(corpus(spark, sf).select("doc_id", "path"), "doc_id")
    return pins.union_pins(pins.rank_pins(_pins(spark, sf)), retrieved).select("query_id", "path", "pinned")


@query(
    "dedup_by_content",
    """SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source,
 CASE WHEN trim(text) = '' THEN 'blank' || doc_id ELSE sha256(trim(text)) END ORDER BY doc_id) = 1""",
)
def _(spark, sf):
    ranked = table(spark, sf, "documents").select("source", "doc_id", F.col("text").alias("content"), F.col("doc_id").alias("rank"))
    return context.dedup_by_content(ranked, "source", "rank", "doc_id").select("source", "doc_id")


@query(
    "anchor_chunks",
    f"""WITH {CORPUS}, q AS (SELECT DISTINCT source AS query_id, 'ere ' || source AS text FROM documents)
 SELECT query_id, doc_id, CASE WHEN contains(strip_accents(lower(path || ' ' || title || ' ' || content)), 'ere') OR contains(lower(path), query_id)
 OR language = 'de' THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM q JOIN corpus ON category = query_id""",
)
def _(spark, sf):
    docs = corpus(spark, sf)
    hits = docs.select(F.col("category").alias("query_id"), "doc_id", "path", "title", "content", F.lit(0.5).alias("score"))
    asks = docs.select(F.col("category").alias("query_id")).distinct().withColumn("text", F.concat(F.lit("ere "), "query_id"))
    german = docs.where("language = 'de'").select(F.col("category").alias("query_id"), "path")
    return context.anchor_chunks(hits, asks, german).select("query_id", "doc_id", "score")


@query(
    "sample_checks",
    f"""WITH {CORPUS}, asks AS (SELECT c_custkey AS query_id, 'doc-' || c_custkey AS text FROM customer),
 {_bm25('asks', 'corpus', 'doc_id', 'title')}, hits AS ({_top('lex', 'doc_id', 5)})
 SELECT a.query_id AS doc_id, c.doc_id IS NOT NULL AS present, e.vec_id IS NOT NULL AS has_vector, h.doc_id IS NOT NULL AS search_found
 FROM asks a LEFT JOIN corpus c ON c.doc_id = a.query_id LEFT JOIN embeddings e ON e.vec_id = a.query_id LEFT JOIN hits h ON h.query_id = a.query_id AND h.doc_id = a.query_id""",
)
def _(spark, sf):
    """Documents expected by number, some of which were never stored: are they there, have they a vector, does a search find them?"""
    docs = corpus(spark, sf).select("doc_id", "title")
    asks = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("doc-"), "c_custkey").alias("text"))
    titles = build_index(docs, work_folder(spark, "title-index"), "doc_id", "title")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return changes.sample_checks(asks, docs.select("doc_id"), vectors, indexed_search(asks, titles, 5))


@query(
    "expired_trash",
    """SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-30' - INTERVAL 30 DAY""",
)
def _(spark, sf):
    trash = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("deleted_at"))
    return ops.expired_trash(trash, F.lit("2000-06-30").cast("timestamp")).select("o_orderkey")


