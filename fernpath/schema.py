"""The table of files and the fixed facts about it."""

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("full_path", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("mtime", T.LongType(), False),
        T.StructField("mode", T.IntegerType(), False),
        T.StructField("mime_type", T.StringType(), False),
    ]
)
COLUMNS = [f.name for f in FILES]
FORMAT_VERSION = 2
OCTETS = "application/octet-stream"
