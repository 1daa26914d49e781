"""Row types of the stage tables."""

from pyspark.sql import types as T

EMAIL = T.StructType(
    [
        T.StructField("email", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("thread", T.ArrayType(T.StringType())),
        T.StructField("date", T.StringType()),
        T.StructField("summary", T.StringType()),
    ]
)

# One row per leaf part of a message.
PARTS = T.StructType(
    [
        T.StructField("msg_id", T.StringType()),
        T.StructField("part_no", T.IntegerType()),
        T.StructField("from_addr", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("date_raw", T.StringType()),
        T.StructField("date_iso", T.StringType()),
        T.StructField("date_us", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

CHAT_MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)

# Chunk rows without their documents, which stand in a payload table by doc_id.
KEYED_CHUNKS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("chunk", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("index_name", T.StringType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("chunk", T.StringType()),
        T.StructField("email", EMAIL),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("index_name", T.StringType()),
    ]
)
