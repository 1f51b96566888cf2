"""Queries over library items, requests, transactions and their stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import items, transactions, validation
from docloom.plans import structures
from docloom.plans.common import documents, long
from docloom.session import table
from docloom.sources import packages
from docloom.streaming import requests as stream


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("item_key"), F.coalesce("text", F.lit("")).alias("title"), F.col("source").alias("collection"), F.col("lang").alias("item_type"), F.col("n_chars").alias("date_modified")
    )


def t07_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of English items whose title holds "the", longest first."""
    return items.search(_items(spark, sf_dir), "the", item_type="en", limit=100, start=100).select("item_key", "title", "date_modified")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the parts of its lines in line order, twice over; some are beyond the parts there are."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("req_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    keys = F.transform("lines", lambda x: x["l_partkey"] + F.when(x["l_partkey"] % 7 == 0, 10_000_000).otherwise(0))
    return lines.select("req_id", F.concat(keys, keys).alias("keys"))


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_key"), "p_name")


def t08_get_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.get_items(_requests(spark, sf_dir), _library(spark, sf_dir)).select("req_id", long("place"), "item_key", "p_name")


def t08_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.missing_keys(_requests(spark, sf_dir), _library(spark, sf_dir)).select("req_id", long("place"), "item_key")


def n02_valid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.upper(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 8))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.translate(key, "01O", "2XZ")).otherwise(key).alias("key"))
    return rows.withColumn("valid", items.valid_key(F.col("key")))


def n05_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four shapes made from events; their CSL data is an object, its text, or the text of a list of one. Keys are digests of the events; those with a 0 or 1 are none."""
    return _normalised(spark, sf_dir)


def _record(n: Column, k: Column, shape: Column) -> Column:
    return (
        F.when(shape == 0, F.concat(F.lit('{"key":"'), n, F.lit('","version":'), k, F.lit(',"library":{"type":"user","id":7},"csljson":{"id":1}}')))
        .when(shape == 1, F.concat(F.lit('{"data":{"key":"'), n, F.lit('","version":"'), k, F.lit('"},"library":{"type":"group","id":8},"cslJSON":"{\\"id\\":2}"}')))
        .when(shape == 2, F.concat(F.lit('{"itemKey":"'), n, F.lit('","uri":"u/'), k, F.lit('","csl":"[{\\"id\\":3}]"}'))).otherwise(F.lit('{"version":"x","csl":"{broken"}'))
    )


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.upper(F.substring(F.md5(F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", "props")), 1, 8))
    record = _record(digest, F.get_json_object("props", "$.k"), F.get_json_object("props", "$.k").cast("int") % 4)
    rows = table(spark, sf_dir, "events").select("event_id", digest.alias("digest"), record.alias("record"))
    found = rows.select("event_id", *items.normalised(F.col("record"), F.col("digest")))
    return found.withColumn("version", F.coalesce("version", F.lit(-1).cast("long")))


def n04_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of six shapes, each about an event: a list, items, results, one record, records by key, and what is none."""
    n = F.col("event_id").cast("string")
    one = F.concat(F.lit('{"key":"K'), n, F.lit('"}'))
    answer = F.element_at(F.array(
        F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")), F.concat(F.lit('{"items":['), one, F.lit("]}")), F.concat(F.lit('{"results":['), one, F.lit(',5]}')), one,
        F.concat(F.lit('{"A":{"x":'), n, F.lit('},"B":7}')), F.lit("5"),
    ), (F.col("event_id") % 6 + 1).cast("int"))
    found = items.records(table(spark, sf_dir, "events").select("event_id", answer.alias("payload")), ["event_id"])
    return found.select("event_id", F.coalesce(long("place"), F.lit(-1)).alias("place"), "hinted_key", "record", "error")


def n03_checked_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("user", "group", "team", None))), (F.col("event_id") % 4 + 1).cast("int"))
    number = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", items.checked_library(kind, number).alias("error"))


def x02_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are staged documents; those with a dangling relationship don't pass the gate, external ones are warnings."""
    rels, parts = structures._relationships(spark, sf_dir)
    findings = validation.united([validation.dangling(rels, parts), validation.external(rels)])
    staged = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_path"), F.sha2("o_orderpriority", 256).alias("source_sha256"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).alias("idempotency_key"))
    now = F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'")
    return transactions.registered(staged, findings, now).select("doc_path", "error", "warnings", "transaction_id", F.date_format("expires_at", "HH:mm").alias("expires"))


def s15_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local answers of all events, web answers of the even ones; the status goes by the event's type and number."""
    statuses = F.element_at(F.array(*[F.lit(x) for x in (200, 403, 404, 429, 500, 501, None)]), (F.col("event_id") % 7 + 1).cast("int"))
    local = table(spark, sf_dir, "events").select("event_id", statuses.alias("status"), F.col("event_type").alias("body"))
    web = table(spark, sf_dir, "events").filter("event_id % 2 = 0").select("event_id", F.lit(200).alias("status"), F.concat(F.lit("web "), "event_type").alias("body"))
    rows = items.with_fallback(local, web, ["event_id"])
    code = items.error_code(F.col("status"), F.col("origin") == "local")
    return rows.select("event_id", "origin", "body", code.alias("error"), F.coalesce(items.retryable(F.col("status")), F.lit(True)).alias("retryable"))


def t06_source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all events as the local source's, of the even ones as the web's."""
    statuses = lambda k: F.element_at(F.array(*[F.lit(x) for x in (200, 403, 404, 429, 500, 501, None)]), ((F.col("event_id") + k) % 7 + 1).cast("int")).alias("status")
    events = table(spark, sf_dir, "events")
    return items.source_status(events.select(statuses(0)), events.filter("event_id % 2 = 0").select(statuses(3)))


def s19_expected_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for files; some are expected as they were before, some aren't there."""
    docs = documents(spark, sf_dir)
    path, digest = F.col("doc_id").cast("string").alias("doc_path"), F.sha2(F.coalesce("text", F.lit("")), 256)
    files = docs.filter("n_chars % 5 <> 0").select(path, digest.alias("sha256"))
    expected = docs.select(path, F.when(F.col("n_chars") % 3 == 0, F.upper(digest)).when(F.col("n_chars") % 3 == 1, F.sha2("source", 256)).alias("expected_sha256"))
    return packages.checked_hashes(files, expected).select("doc_path", "error")


def x01_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests are events; user and type are the key; the first of a key stands."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return transactions.first_per_key(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def x01_stream_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same keys from a stream over the events' file, kept once within a watermark."""
    return stream.run_once(spark, f"{sf_dir}/events.parquet", ["user_id", "event_type"]).select("user_id", "event_type")


def x03_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the last hour before a fixed now."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"))
    now = F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'")
    return transactions.live(rows.filter(F.col("created_at") <= now), now).select("event_id")


def x05_commit_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a staged document, its lines are the content: hashed as staged, and again without what was shipped before the order.

    Several guards can fail, and the first one names the outcome.
    """
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    line = F.format_string("%05d %05d %05d", "l_linenumber", "l_partkey", "l_suppkey")
    hashed = lambda kept: F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(kept, line))), "\n"), 256)
    content = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.bool_or(F.col("l_returnflag") == "R").alias("there"), hashed(F.lit(True)).alias("staged"), hashed(F.col("l_shipdate") >= F.col("o_orderdate")).alias("now"),
    )
    status, size = F.col("o_orderstatus"), F.coalesce("lines", F.lit(0))
    outcome = transactions.commit_outcome(
        size > 0, F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_totalprice") > 50_000, F.when((status == "P") & F.col("there"), ".doc").otherwise(".DOCX"),
        F.col("there"), status == "O", size > 5, (status == "F") & (size == 1), F.col("staged") == F.col("now"),
    )
    return orders.join(content, "o_orderkey", "left").select("o_orderkey", outcome.alias("outcome"))


def x04_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transaction_id"), "o_custkey")
    gone = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("transaction_id"))
    return transactions.abort(rows, gone)


def k08_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit texts of commits, read back."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transaction_id"), F.when(F.col("o_orderkey") % 3 == 0, "backup").alias("backup_path"), F.col("o_orderpriority").alias("intent"))
    told = transactions.audit_rows(rows, ["transaction_id", "backup_path", "intent"])
    back = F.from_json("audit", "schema_version INT, transaction_id BIGINT, backup_path STRING, intent STRING").alias("back")
    return told.select(back, F.contains("audit", F.lit('"backup_path":null')).alias("null_written")).select("back.transaction_id", "back.backup_path", "back.intent", "null_written")


QUERIES = {
    f.__name__: f
    for f in (t07_search, t08_get_items, t08_missing, n02_valid_keys, n03_checked_library, n04_records, n05_normalised, x02_registered, s15_fallback, t06_source_status, s19_expected_hash, x01_idempotency, x01_stream_keys, x03_expiry, x05_commit_ladder, x04_abort, k08_audit_rows)
}

_REQUESTS = """
  SELECT l_orderkey AS req_id, item_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) - 1 AS place
  FROM (SELECT l_orderkey, l_partkey + CASE WHEN l_partkey % 7 = 0 THEN 10000000 ELSE 0 END AS item_key, min(n) AS first
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) GROUP BY 1, 2)"""

ORACLES = {
    "t07_search": """
        SELECT doc_id AS item_key, coalesce(text, '') AS title, n_chars AS date_modified FROM documents
        WHERE lang = 'en' AND contains(lower(coalesce(text, '')), 'the') ORDER BY n_chars DESC, doc_id LIMIT 100 OFFSET 100""",
    "t08_get_items": f"SELECT req_id, place, item_key, p_name FROM ({_REQUESTS}) JOIN part ON p_partkey = item_key",
    "t08_missing": f"SELECT req_id, place, item_key FROM ({_REQUESTS}) WHERE item_key NOT IN (SELECT p_partkey FROM part)",
    "n02_valid_keys": f"""
        SELECT c_custkey, key, regexp_matches(key, '{items.KEY_PATTERN}') AS valid
        FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN translate(upper(md5(CAST(c_custkey AS VARCHAR))[1:8]), '01O', '2XZ') ELSE upper(md5(CAST(c_custkey AS VARCHAR))[1:8]) END AS key FROM customer)""",
    "n05_normalised": """
        WITH e AS (SELECT event_id, upper(md5(event_id || ' ' || event_type || ' ' || props)[1:8]) AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
        f AS (SELECT *, k % 4 AS s, NOT (contains(key, '0') OR contains(key, '1')) AS ok FROM e)
        SELECT event_id, CASE WHEN ok THEN key END AS item_key, CASE WHEN ok AND s <= 1 THEN k ELSE -1 END AS version,
               CASE WHEN ok THEN CASE s WHEN 0 THEN '{"id":1}' WHEN 1 THEN '{"id":2}' WHEN 2 THEN '{"id":3}' END END AS csl_json,
               CASE WHEN ok THEN CASE s WHEN 0 THEN 'http://zotero.org/users/7/items/' || key WHEN 1 THEN 'http://zotero.org/groups/8/items/' || key WHEN 2 THEN 'u/' || k END END AS uri,
               CASE WHEN NOT ok THEN 'ZOTERO_INCOMPATIBLE' END AS error FROM f""",
    "n04_records": """
        WITH e AS (SELECT event_id, event_id % 6 AS s, '{"key":"K' || event_id || '"}' AS one FROM events)
        SELECT event_id, CAST(0 AS BIGINT) AS place, CASE WHEN s = 4 THEN 'A' END AS hinted_key, CASE WHEN s = 4 THEN '{"x":' || event_id || '}' ELSE one END AS record, NULL AS error FROM e WHERE s IN (0, 1, 3, 4)
        UNION ALL SELECT event_id, 1, NULL, one, NULL FROM e WHERE s = 0
        UNION ALL SELECT event_id, -1, NULL, NULL, 'ZOTERO_INCOMPATIBLE' FROM e WHERE s IN (2, 5)""",
    "n03_checked_library": "SELECT event_id, CASE WHEN event_id % 4 >= 2 OR event_id % 5 = 0 THEN 'INVALID_REQUEST' END AS error FROM events",
    "x02_registered": """
        SELECT CAST(o_orderkey AS VARCHAR) AS doc_path, CASE WHEN bad THEN 'VALIDATION_FAILED' END AS error, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS warnings,
               CASE WHEN NOT bad THEN sha256(o_orderkey || chr(31) || sha256(o_orderpriority) || chr(31) || CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END || chr(31) || '2024-01-15 12:00:00')[1:32] END AS transaction_id,
               CASE WHEN NOT bad THEN '13:00' END AS expires
        FROM (SELECT *, o_orderstatus = 'F' AND o_orderkey % 10 <> 0 AS bad FROM orders)""",
    "s15_fallback": """
        WITH l AS (SELECT event_id, [200, 403, 404, 429, 500, 501, NULL][event_id % 7 + 1] AS status, event_type AS body FROM events),
        f AS (SELECT *, coalesce(status, 0) IN (0, 403, 404, 501) AS failed FROM l)
        SELECT event_id, 'local' AS origin, body, CASE status WHEN 429 THEN 'ZOTERO_UNAVAILABLE' WHEN 500 THEN 'ZOTERO_UNAVAILABLE' END AS error, status IN (429, 500) AS retryable FROM f WHERE NOT failed
        UNION ALL SELECT event_id, 'web', 'web ' || body, NULL, false FROM f WHERE failed AND event_id % 2 = 0""",
    "t06_source_status": """
        WITH a AS (SELECT 'local' AS origin, [200, 403, 404, 429, 500, 501, NULL][event_id % 7 + 1] AS status FROM events
                   UNION ALL SELECT 'web', [200, 403, 404, 429, 500, 501, NULL][(event_id + 3) % 7 + 1] FROM events WHERE event_id % 2 = 0),
        c AS (SELECT origin, CASE WHEN status = 200 THEN NULL WHEN status IN (429, 500, 403) OR status IS NULL THEN 'ZOTERO_UNAVAILABLE' WHEN status = 501 OR origin = 'local' THEN 'ZOTERO_INCOMPATIBLE' ELSE 'INVALID_REQUEST' END AS code, count(*) AS n
              FROM a GROUP BY ALL)
        SELECT origin, CAST(sum(n) AS BIGINT) AS answers, bool_or(code IS NULL) AS available, arg_max(code, n) FILTER (WHERE code IS NOT NULL) AS error FROM c GROUP BY origin""",
    "s19_expected_hash": """
        SELECT CAST(doc_id AS VARCHAR) AS doc_path, CASE WHEN n_chars % 5 = 0 THEN 'DOCUMENT_NOT_FOUND' WHEN n_chars % 3 = 1 THEN 'STALE_REVISION' END AS error FROM documents""",
    "x01_idempotency": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "x01_stream_keys": "SELECT DISTINCT user_id, event_type FROM events",
    "x03_expiry": "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts > TIMESTAMP '2024-01-15 11:00:00'",
    "x05_commit_ladder": """
        WITH l AS (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS there, bool_and(l_shipdate >= o_orderdate) AS same
                   FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)
        SELECT o_orderkey, CASE WHEN n IS NULL THEN 'TRANSACTION_NOT_FOUND' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'INVALID_REQUEST' WHEN o_totalprice <= 50000 THEN 'PATH_NOT_ALLOWED'
               WHEN o_orderstatus = 'P' AND there THEN 'UNSUPPORTED_DOCUMENT' WHEN there AND o_orderstatus <> 'O' THEN 'COMMIT_CONFLICT' WHEN n > 5 OR o_orderstatus = 'F' AND n = 1 THEN 'FILE_IN_USE'
               WHEN NOT same THEN 'COMMIT_CONFLICT' END AS outcome FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "x04_abort": "SELECT o_orderkey AS transaction_id, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "k08_audit_rows": """
        SELECT o_orderkey AS transaction_id, CASE WHEN o_orderkey % 3 = 0 THEN 'backup' END AS backup_path, o_orderpriority AS intent, o_orderkey % 3 <> 0 AS null_written FROM orders""",
}
