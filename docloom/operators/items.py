"""Library items: normalising, searching, fetching by key, falling back from one source to another, mapping errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.paragraphs import page

#: The alphabet and length of an item key, and the codes that allow the second source.
KEY_PATTERN = "^[23456789ABCDEFGHIJKLMNPQRSTUVWXYZ]{8}$"
FALLBACK_STATUS = (403, 404, 405, 501)
URI_BASE = "http://zotero.org"


def valid_key(key: Column) -> Column:
    return F.regexp_like(key, F.lit(KEY_PATTERN))


def search(items: DataFrame, query: str = "", collection: str | None = None, item_type: str | None = None, tag: str | None = None, sort: str = "date_modified", direction: str = "desc", limit: int = 20, start: int = 0, key: str = "item_key") -> DataFrame:
    """Filters, a total order and a page. Arguments are checked before a plan is made; filters reach the scan."""
    if not 1 <= limit <= 100 or start < 0 or direction not in ("asc", "desc"):
        raise ValueError("limit is 1 to 100, start 0 or more, direction asc or desc")
    rows = items
    for column, value in (("collection", collection), ("item_type", item_type), ("tag", tag)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    if query:
        rows = rows.filter(F.contains(F.lower("title"), F.lit(query.lower())))
    order = F.asc(sort) if direction == "asc" else F.desc(sort)
    return page(rows, [order, key], start, limit)


def get_items(requests: DataFrame, items: DataFrame, key: str = "item_key") -> DataFrame:
    """requests (req_id, keys): found items at the place of their key's first mention."""
    wanted = requests.select("req_id", F.posexplode(F.array_distinct("keys")).alias("place", key))
    return wanted.join(items, key)


def missing_keys(requests: DataFrame, items: DataFrame, key: str = "item_key") -> DataFrame:
    wanted = requests.select("req_id", F.posexplode(F.array_distinct("keys")).alias("place", key))
    return wanted.join(items.select(key), key, "left_anti")


def first_text(payload: Column, *paths: str) -> Column:
    """The first member that is there and not empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths])


def records(answers: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """answers (keep..., payload: JSON) -> one row per item record: keep..., place, hinted_key, record, error.

    A list holds records, as do the members ``items`` and ``results`` of an object; an object with a record's own members
    is one; any other object maps keys to records. What is none of these, or holds what is no object, is an error row.
    """
    value = F.try_parse_json(payload)
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    member = lambda name: F.try_variant_get("value", f"$.{name}", "variant")
    rows = answers.select(*keep, value.alias("value"), kind(value).alias("kind"))
    is_object = F.startswith("kind", F.lit("OBJECT"))
    listed = F.when(F.startswith("kind", F.lit("ARRAY")), F.col("value"))
    for name in ("results", "items"):
        listed = F.when(is_object & F.startswith(kind(member(name)), F.lit("ARRAY")), member(name)).otherwise(listed)
    own = [kind(member(name)) != "VOID" for name in ("key", "itemKey", "data", "csljson", "cslJSON")]
    single = is_object & (own[0] | own[1] | own[2] | own[3] | own[4])
    text = lambda v: F.to_json(v)
    entry = lambda key, v: F.struct(key.cast("string").alias("hinted_key"), v.alias("value"))
    none = F.lit(None)
    by_key = F.transform(F.map_entries(F.try_variant_get("value", "$", "map<string,variant>")), lambda e: entry(e["key"], e["value"]))
    mapped = F.filter(by_key, lambda e: F.startswith(F.coalesce(F.schema_of_variant(e["value"]), F.lit("")), F.lit("OBJECT")))
    rows = rows.withColumn("listed", listed).withColumn("single", single)
    found = (
        F.when(F.col("listed").isNotNull(), F.transform(F.try_variant_get("listed", "$", "array<variant>"), lambda v: entry(none, v)))
        .when(F.col("single"), F.array(entry(none, F.col("value")))).when(is_object, mapped)
    )
    rows = rows.withColumn("found", found)
    strange = F.exists("found", lambda e: ~F.startswith(F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID")), F.lit("OBJECT")))
    empty = is_object & F.col("listed").isNull() & ~F.col("single") & (F.size("found") == 0) & (F.size(F.map_keys(F.try_variant_get("value", "$", "map<string,variant>"))) > 0)
    bad = F.coalesce(F.col("found").isNull() | strange | empty, F.lit(True))
    error = F.when(bad, "ZOTERO_INCOMPATIBLE")
    each = rows.withColumn("error", error).select(*keep, "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("found"))).alias("place", "e"))
    return each.filter("error IS NOT NULL OR e IS NOT NULL").select(*keep, "place", "e.hinted_key", text(F.col("e.value")).alias("record"), "error")


def checked_library(library_type: Column, library_id: Column) -> Column:
    """The error of a library that is none: its type is user or group, its id a number."""
    return F.when(~F.coalesce(library_type.isin("user", "group") & F.regexp_like(library_id, F.lit("^[0-9]+$")), F.lit(False)), "INVALID_REQUEST")


def csl_of(payload: Column) -> Column:
    """The record's CSL data as a JSON object: the first of its members that is one, or the text of one, or of a list of one."""

    def one(name: str) -> Column:
        said = F.get_json_object(payload, f"$.{name}")
        read = F.try_parse_json(said)
        shape = F.coalesce(F.schema_of_variant(read), F.lit("VOID"))
        lone = F.try_variant_get(read, "$", "array<variant>")
        is_lone = F.startswith(shape, F.lit("ARRAY<OBJECT")) & (F.size(lone) == 1)
        return F.when(F.startswith(shape, F.lit("OBJECT")), said).when(is_lone, F.to_json(F.get(lone, 0)))

    return F.coalesce(*[one(name) for name in ("csljson", "cslJSON", "csl")])


def _told(payload: Column, path: str) -> Column:
    """A member that is there and says something: its text, or for what is no text one that is no key."""
    value = F.try_parse_json(payload)
    text, kind = F.try_variant_get(value, path, "string"), F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.when(kind == "STRING", F.nullif(text, F.lit(""))).when(text.isNotNull() & ~text.isin("0", "false", "[]", "{}"), "?")


def normalised(payload: Column, hinted_key: Column | None = None) -> list[Column]:
    """item_key, version, csl_json, uri and error of one record, whatever shape it came in.

    A record without a key of the library's form, or with one that is no text, is incompatible and has nothing but its error.
    """
    hint = F.lit(None).cast("string") if hinted_key is None else hinted_key
    told = F.coalesce(*[_told(payload, path) for path in ("$.key", "$.itemKey", "$.data.key")], F.nullif(hint, F.lit("")))
    item_key = F.when(valid_key(told), told)
    version = first_text(payload, "$.version", "$.data.version")
    version = F.when(F.regexp_like(version, F.lit("^-?[0-9]+$")), version.try_cast("bigint"))
    library_type, library_id = F.get_json_object(payload, "$.library.type"), F.get_json_object(payload, "$.library.id")
    known = item_key.isNotNull()
    return [
        item_key.alias("item_key"), F.when(known, version).alias("version"), F.when(known, csl_of(payload)).alias("csl_json"), F.when(known, item_uri(payload, library_type, library_id, item_key)).alias("uri"),
        F.when(~known, "ZOTERO_INCOMPATIBLE").alias("error"),
    ]


def item_uri(payload: Column, library_type: Column, library_id: Column, key: Column) -> Column:
    """The record's own uri, its links, else one made from the library."""
    where = F.when(library_type == "user", "users").when(library_type == "group", "groups")
    made = F.concat(F.lit(f"{URI_BASE}/"), where, F.lit("/"), library_id, F.lit("/items/"), key)
    return F.coalesce(first_text(payload, "$.uri", "$.data.uri", "$.links.self.href", "$.links.alternate.href"), made)


def may_fall_back(status: Column) -> Column:
    """No status stands for a transport error."""
    return status.isNull() | status.isin(*FALLBACK_STATUS)


def with_fallback(local: DataFrame, web: DataFrame, keys: list[str]) -> DataFrame:
    """local and web (keys, status, body): the local answer unless it failed in a way that allows the other source."""
    failed = (F.coalesce("status", F.lit(0)) != 200) & may_fall_back(F.col("status"))
    served = local.filter(~failed).withColumn("origin", F.lit("local"))
    asked = web.join(local.filter(failed).select(*keys), keys, "left_semi").withColumn("origin", F.lit("web"))
    return served.unionByName(asked)


def source_status(local: DataFrame, web: DataFrame) -> DataFrame:
    """local and web (status) -> a row per source: origin, answers, available (an answer came through), and the most frequent error code, of equal ones the first."""
    both = local.select(F.lit("local").alias("origin"), "status").unionByName(web.select(F.lit("web").alias("origin"), "status"))
    coded = both.select("origin", error_code(F.col("status"), F.col("origin") == "local").alias("code")).groupBy("origin", "code").count()
    worst = F.min(F.when(F.col("code").isNotNull(), F.struct((-F.col("count")).alias("less"), "code")))
    return coded.groupBy("origin").agg(F.sum("count").alias("answers"), F.bool_or(F.col("code").isNull()).alias("available"), worst["code"].alias("error"))


def error_code(status: Column, local: Column) -> Column:
    """Error code of a failed answer; null for success."""
    return (
        F.when(status.isNull(), "ZOTERO_UNAVAILABLE")
        .when(status < 400, F.lit(None).cast("string"))
        .when(status.isin(401, 403), "ZOTERO_UNAVAILABLE")
        .when(status.isin(405, 501) | (status == 404) & local, "ZOTERO_INCOMPATIBLE")
        .when((status == 429) | (status >= 500), "ZOTERO_UNAVAILABLE")
        .otherwise("INVALID_REQUEST")
    )


def retryable(status: Column) -> Column:
    return status.isNull() | (status == 429) | (status >= 500) & (status != 501)
