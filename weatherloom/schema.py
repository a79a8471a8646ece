"""Column names and schemas shared by all operators."""

from pyspark.sql import types as T

CITY = "city"
TIMESTAMP = "timestamp"
TEMPERATURE = "temperature"
SEASON = "season"
SEQ = "seq"

# seq is unique; it breaks ties between equal timestamps of one city.
READINGS = T.StructType(
    [
        T.StructField(CITY, T.StringType()),
        T.StructField(TIMESTAMP, T.TimestampNTZType()),
        T.StructField(TEMPERATURE, T.DoubleType()),
        T.StructField(SEASON, T.StringType()),
        T.StructField(SEQ, T.LongType()),
    ]
)

# One current-reading payload. Status codes come both as numbers and as text.
PAYLOAD = T.StructType(
    [
        T.StructField("cod", T.StringType()),
        T.StructField("dt", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("main", T.StructType([T.StructField("temp", T.DoubleType())])),
        T.StructField("message", T.StringType()),
    ]
)

# Order in which a city's readings follow each other.
SERIES_ORDER = (TIMESTAMP, SEQ)
