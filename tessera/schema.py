"""Schemas of the chunk table, the sync registry and the result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types by the names that the schemas below use.
_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType()),
}


def _schema(fields: str) -> T.StructType:
    """Known without a session, unlike a parsed DDL string."""
    return T.StructType([T.StructField(*named[:1], _TYPES[named[1]]) for named in (f.split() for f in fields.split(","))])


CHUNKS = _schema(
    "text string, vector array<float>, document_name string, document_path string, collection string, page_number int,"
    " total_pages int, chunk_index int, page_raw_text string, page_type string, source_format string,"
    " ingestion_timestamp timestamp, agent_handle string, memory_type string, summary string"
)
PAGES = _schema("document_name string, document_path string, page_number int, total_pages int, text string, page_type string")
DIRECTORIES = _schema("directory string, collection string, registered_at string")
FILES = _schema(
    "path string, collection string, document_name string, mtime double, size long, ingested_at string, content_hash string,"
    " chunks_committed int, partial_hash string"
)
RETAINED = _schema("collection string, retained_at string, original_directory string")
PENDING = _schema("collection string, marked_at string")
EVENTS = _schema("database string, collection string, path string, deleted boolean, ts timestamp, seq long")

#: Columns that later versions of the chunk table added, all with '' for older rows.
ADDED = ("agent_handle", "memory_type", "summary")


def migrate(chunks: DataFrame) -> DataFrame:
    """M5: any older chunk table in the current schema. Added columns are ''; other absent columns are null. Idempotent."""
    have = set(chunks.columns)

    def column(field: T.StructField):
        value = F.col(field.name).cast(field.dataType) if field.name in have else F.lit(None).cast(field.dataType)
        return (F.coalesce(value, F.lit("")) if field.name in ADDED else value).alias(field.name)

    return chunks.select(*map(column, CHUNKS.fields))
