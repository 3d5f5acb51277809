"""The driver tables in the roles the operators expect, in Spark and in SQL.

documents -> corpus with paths; customer -> scanned files; orders -> tasks and
answers; lineitem -> sources of an answer and pages of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.scale import spread


TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in TEXTS else df


# --- corpus ------------------------------------------------------------------------------

_CORPUS_EXT = "CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.html' ELSE '.json' END"
_CORPUS = f"""doc_id, text AS content, lang AS language, source AS category, n_chars,
 '/corpus/' || source || '/' || lang || '/doc-' || doc_id || {_CORPUS_EXT} AS path,
 'doc-' || doc_id AS title, {_CORPUS_EXT} AS file_type"""
CORPUS = f"corpus AS (SELECT {_CORPUS} FROM documents)"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(*_split(_CORPUS))


def _split(columns: str) -> list[str]:
    """Top-level comma-separated parts of a select list."""
    parts, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            parts.append(columns[start:i])
            start = i + 1
    return [*parts, columns[start:]]


# --- files: customers as files of a folder tree ------------------------------------------

_SEGMENT_EXT = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '.txt' WHEN 'BUILDING' THEN '.pdf'
 WHEN 'FURNITURE' THEN '.docx' WHEN 'HOUSEHOLD' THEN '.py' ELSE '.xyz' END"""
_FILES = f"""c_custkey, '/' || r_name || '/' || n_name || '/cust-' || c_custkey || {_SEGMENT_EXT} AS path,
 c_mktsegment, c_acctbal, r_name"""
FILES = f"""files AS (SELECT {_FILES} FROM customer JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(*_split(_FILES))


# Two scans of the same tree: files touched in 1995, and from mid-1995 to mid-1996.
def _snapshot(name: str, low: str, high: str) -> str:
    return f"""{name} AS (SELECT path, epoch(max(o_orderdate))::DOUBLE AS mtime FROM orders
 JOIN files ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '{low}' AND o_orderdate < TIMESTAMP '{high}'
 GROUP BY path)"""


_PREV, _CUR = ("1995-01-01", "1996-01-01"), ("1995-07-01", "1996-07-01")
SNAPSHOTS = f"{FILES}, {_snapshot('prev', *_PREV)}, {_snapshot('cur', *_CUR)}"


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    tree = files(spark, sf)
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate")

    def touched(low: str, high: str) -> DataFrame:
        window = orders.where((F.col("o_orderdate") >= F.lit(low).cast("timestamp")) & (F.col("o_orderdate") < F.lit(high).cast("timestamp")))
        last = window.groupBy("o_custkey").agg(F.max("o_orderdate").alias("_d"))
        return last.join(tree, F.col("o_custkey") == F.col("c_custkey")).select(
            "path", (F.unix_micros(F.col("_d").cast("timestamp")) / 1e6).alias("mtime")
        )

    return touched(*_PREV), touched(*_CUR)


LIVE_ROOTS = "roots AS (SELECT '/' || r_name AS root FROM region WHERE r_name < 'EUROPE')"


def live_roots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").where("r_name < 'EUROPE'").select(F.concat(F.lit("/"), "r_name").alias("root"))


# --- tasks: orders as work on files -------------------------------------------------------

_TASKS = """CAST(o_orderkey AS STRING) AS id, path AS file_path, lower(c_mktsegment) AS task_type,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'normal' END AS priority,
 CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE CASE WHEN o_totalprice < 400000 THEN 'completed' ELSE 'failed' END END AS status,
 o_orderdate AS added_at, o_orderdate AS started_at, finished AS completed_at,
 CASE WHEN o_orderstatus = 'F' AND o_totalprice >= 450000 THEN 'No extractor for this file' WHEN o_orderstatus = 'F' AND o_totalprice >= 400000 THEN 'decode error' END AS error_message,
 CAST(floor(o_totalprice / 100000) AS INT) AS retry_count"""
TASKS = f"""{FILES}, finish AS (SELECT l_orderkey, max(l_shipdate) AS finished FROM lineitem GROUP BY l_orderkey),
 tasks AS (SELECT {_TASKS} FROM orders JOIN files ON o_custkey = c_custkey LEFT JOIN finish ON o_orderkey = l_orderkey)"""


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    finish = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("finished"))
    return (
        table(spark, sf, "orders")
        .join(files(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
        .join(finish, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .selectExpr(*_split(_TASKS))
    )


FAILURES = """failures AS (SELECT file_path AS path, max(retry_count) AS retry_count, max(completed_at) AS ts,
 max(CASE WHEN error_message LIKE 'No extractor%' THEN 'unsupported' WHEN error_message IS NOT NULL THEN 'encoding' END) AS reason
 FROM tasks WHERE status = 'failed' GROUP BY file_path)"""


def failures(spark: SparkSession, sf: str) -> DataFrame:
    reason = F.when(F.startswith("error_message", F.lit("No extractor")), "unsupported").when(
        F.col("error_message").isNotNull(), "encoding"
    )
    return tasks(spark, sf).where("status = 'failed'").groupBy(F.col("file_path").alias("path")).agg(
        F.max("retry_count").alias("retry_count"), F.max("completed_at").alias("ts"), F.max(reason).alias("reason")
    )


# --- answers: one per order, its lines as sources ------------------------------------------

_LINES = """SELECT l_orderkey, l_linenumber, sum(l_quantity) AS qty, max(l_extendedprice) AS price,
 min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber"""
_LINE_PATH = "'/orders/' || l_orderkey || '/line-' || l_linenumber || '.md'"
_CONTEXTS = f"""l_orderkey AS answer_id, l_linenumber AS rank, {_LINE_PATH} AS path, 'line-' || l_linenumber AS title,
 '# Line item ' || l_linenumber || ' of order' || chr(10) || 'Quantity ' || CAST(qty AS DECIMAL(15,2)) || ' at price '
 || CAST(price AS DECIMAL(15,2)) || ' flag ' || flag AS content"""
CONTEXTS = f"contexts AS (SELECT {_CONTEXTS} FROM ({_LINES}) grouped)"


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("qty"), F.max("l_extendedprice").alias("price"), F.min("l_returnflag").alias("flag")
    )
    return lines.selectExpr(*_split(_CONTEXTS))


_ANSWER_TEXT = """'According to line-' || first_line || '.md the amount is ' || CAST(top_price AS DECIMAL(15,2))
 || '. The order total is ' || CAST(o_totalprice AS DECIMAL(15,2)) || ' and the source line-' || first_line
 || ' agrees. See summary-' || o_custkey || '.pdf for the price ' || CAST(top_price AS DECIMAL(15,2))
 || '. The quantity of two items is confirmed.' || chr(10) || 'Le premier document de la liste.' || chr(10)
 || '⚠️ Avertissement automatique 1.' || chr(10) || 'The file line-' || first_line || ' is open.'"""
_ANSWERS = f"o_orderkey AS answer_id, 'Where is code ' || o_orderpriority || '-2024 of line?' AS question, {_ANSWER_TEXT} AS text"
ANSWERS = f"""lines AS (SELECT l_orderkey, min(l_linenumber) AS first_line, max(l_extendedprice) AS top_price FROM lineitem
 GROUP BY l_orderkey), answers AS (SELECT {_ANSWERS} FROM orders JOIN lines ON o_orderkey = l_orderkey), {CONTEXTS}"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_linenumber").alias("first_line"), F.max("l_extendedprice").alias("top_price")
    )
    return table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(*_split(_ANSWERS))


# --- questions -------------------------------------------------------------------------------

QUESTIONS = "questions AS (SELECT item_id AS query_id, text FROM benchmark)"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- letter vectors: an embedding both engines can compute ------------------------------------

LETTERS = "etaoinshrdlu"


def letter_vector(text: str = "content"):
    lowered = F.lower(F.col(text))
    return F.array(*[
        (F.length(lowered) - F.length(F.replace(lowered, F.lit(c), F.lit("")))).cast("float") for c in LETTERS
    ])


LETTER_VECTOR = "[" + ", ".join(
    f"CAST(length(lower(content)) - length(replace(lower(content), '{c}', '')) AS DOUBLE)" for c in LETTERS
) + "]"
