"""Staged changes as rows: idempotent requests, expiry, the ladder of guards before a commit, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_SECONDS = 3600


def first_per_key(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first request of a key stands for all later ones, whatever they hold.

    A minimum over the ordered row, pre-aggregated before the shuffle: no key's requests meet in one task.
    """
    rest = [c for c in requests.columns if c not in keys and c not in order]
    least = requests.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return least.select(*keys, "first.*")


def live(transactions: DataFrame, now: Column, ttl: int = TTL_SECONDS, created: str = "created_at") -> DataFrame:
    """Transactions that haven't expired at ``now``; one that expires exactly then has."""
    expires = F.col(created) + F.expr(f"INTERVAL {ttl} SECONDS")
    return transactions.withColumn("expires_at", expires).filter(F.col("expires_at") > now)


def registered(staged: DataFrame, findings: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """staged (doc_path, source_sha256, idempotency_key, ...) -> with transaction_id, created_at, expires_at, error and warnings.

    The gate: a document with an error among its findings (doc_path, severity) isn't registered; warnings go along. The id
    is a digest of document, hash, key and time, so a task that runs again makes the same one.
    """
    counted = findings.groupBy("doc_path").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    met = staged.join(counted, "doc_path", "left").withColumn("error", F.when(F.coalesce("errors", F.lit(0)) > 0, "VALIDATION_FAILED"))
    made = F.substring(F.sha2(F.concat_ws("\x1f", "doc_path", "source_sha256", F.coalesce("idempotency_key", F.lit("")), now.cast("string")), 256), 1, 32)
    passed = lambda c: F.when(F.col("error").isNull(), c)
    return met.select(
        *staged.columns, "error", F.coalesce("warnings", F.lit(0).cast("long")).alias("warnings"), passed(made).alias("transaction_id"), passed(now).alias("created_at"),
        passed(now + F.expr(f"INTERVAL {ttl} SECONDS")).alias("expires_at"),
    )


def commit_outcome(known: Column, token_ok: Column, path_ok: Column, suffix: Column, exists: Column, overwrite: Column, open_elsewhere: Column, locked: Column, source_same: Column) -> Column:
    """The first guard that fails names the outcome; null lets the commit pass."""
    return (
        F.when(~known, "TRANSACTION_NOT_FOUND").when(~token_ok, "INVALID_REQUEST").when(~path_ok, "PATH_NOT_ALLOWED").when(F.lower(suffix) != ".docx", "UNSUPPORTED_DOCUMENT")
        .when(exists & ~overwrite, "COMMIT_CONFLICT").when(open_elsewhere | locked, "FILE_IN_USE").when(~source_same, "COMMIT_CONFLICT")
    )


def abort(transactions: DataFrame, ids: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Transactions without the aborted ones; unknown ids change nothing."""
    return transactions.join(ids.select(key), key, "left_anti")


def audit_rows(commits: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text per commit, nulls written out."""
    fields = F.struct(F.lit(1).alias("schema_version"), *columns)
    return commits.select(*columns, F.to_json(fields, {"ignoreNullFields": "false"}).alias("audit"))
