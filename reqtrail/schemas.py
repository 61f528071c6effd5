"""Spark schemas of the entities."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

FUNCTION = T.StructType(
    [
        T.StructField("function_id", T.IntegerType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("source_code", T.StringType()),
        T.StructField("return_type", T.StringType()),
        T.StructField("parameters", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))),
        T.StructField("condition", T.StringType()),
        T.StructField("dependencies", T.MapType(T.StringType(), STRINGS)),
    ]
)

REQUIREMENT = T.StructType(
    [T.StructField("sr_id", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("sr", "group", "subgroup", "section", "paragraph", "prev_paragraph", "next_paragraph")]
)

# Column names of the requirement tables and of the two protocols' keyword columns.
REQUIREMENT_COLUMNS = ("SR Text", "Current Paragraph", "Previous Paragraph", "Next Paragraph")
HTTP_COLUMNS = {"status_code": "status_code", "field_name": "field_name", "content_coding": "content_coding", "method": "method", "syntax": "syntax", "matched_subcategories": "class"}
TLS_COLUMNS = {
    "ProtocolCoreVersion": "ProtocolCoreVersion",
    "HandshakeFlow": "HandshakeFlow",
    "KeyExchangeSecurity": "KeyExchangeSecurity",
    "AuthenticationCertificates": "AuthenticationCertificates",
    "DataTransferRecordLayer": "DataTransferRecordLayer",
    "SessionManagementAlerts": "SessionManagementAlerts",
    "matched_subcategories": "class",
}


def dual_filter(columns: dict[str, str]) -> T.StructType:
    """Result of the dual filter for a protocol's columns."""
    return T.StructType([T.StructField(c, STRINGS) for c in columns] + [T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])


CANDIDATE = T.StructType(
    [T.StructField("function_id", T.IntegerType()), T.StructField("function_name", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("sr_ids", T.ArrayType(T.IntegerType()))]
)
SEQUENCE = T.StructType([T.StructField("id", T.LongType())] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("name", "api", "tokens", "desc")])
VOCABULARY = T.StructType([T.StructField("word", T.StringType()), T.StructField("id", T.IntegerType())])
VECTOR = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
KEYWORD = T.StructType([T.StructField(c, T.StringType()) for c in ("category", "keyword", "description")])
