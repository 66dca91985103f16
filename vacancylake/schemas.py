"""Record layouts."""

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
LONGS = T.ArrayType(T.LongType())

MATCH = T.StructType(
    [
        T.StructField("keyword", T.StringType()),
        T.StructField("matched_text", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("match_type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("subcategory", T.StringType()),
    ]
)

POSTING = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("title", T.StringType(), False),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("salary", T.StringType()),
        T.StructField("posted_at", T.StringType()),
        T.StructField("applicants", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("tags", STRINGS),
        T.StructField("raw", T.StructType([T.StructField("card_html", T.StringType())])),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

TERM = T.StructType(
    [
        T.StructField("dict", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("subcategory", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("alias", T.StringType()),
        T.StructField("alias_pos", T.IntegerType()),
    ]
)
