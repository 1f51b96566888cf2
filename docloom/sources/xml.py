"""XML texts read by a schema, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def read_xml(xml: Column, schema: str) -> Column:
    """A part's text read by a schema, namespaces aside; attributes begin with ``_``. Null if it doesn't parse or holds a document type or an entity.

    Values are kept as they stand, white space and the word null included. What follows the root is not looked at.
    """
    options = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "nullValue": "\x01", "columnNameOfCorruptRecord": "_unread", "mode": "PERMISSIVE"}
    safe = F.when(~F.regexp_like(xml, F.lit(r"(?i)<!\s*(?:DOCTYPE|ENTITY)\b")), F.regexp_replace(xml, "^\ufeff", ""))
    read = F.from_xml(safe, f"{schema}, `_unread` string", options)
    return F.when(read["_unread"].isNull(), read)
