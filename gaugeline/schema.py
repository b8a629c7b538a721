"""Record types and fixed vocabulary of the metric model."""

from pyspark.sql import types as T

# Metric kinds and the three outcome messages of the service
# (they must equal the reference's strings for reports to compare).
GAUGE = "gauge"
COUNTER = "counter"
KINDS = (GAUGE, COUNTER)
ERR_INVALID_TYPE = "invalid metric type"
ERR_NOT_FOUND = "metric not found"
ERR_BAD_VALUE = "bad metric value"
# Not a service sentinel: a body that does not decode as the expected JSON.
ERR_DECODE = "decode error"

# Integer outcome codes.  Small integers keep gate aggregates on the hash
# aggregate path (a string min_by falls back to a sort aggregate).
CODE_OK = 0
CODE_BAD_VALUE = 1
CODE_INVALID_TYPE = 2
CODE_DECODE = 3
CODE_LABELS = {CODE_BAD_VALUE: ERR_BAD_VALUE, CODE_INVALID_TYPE: ERR_INVALID_TYPE,
               CODE_DECODE: ERR_DECODE}

# One metric update (or one stored metric; a stored counter keeps its total
# in ``delta``).  A null field means "absent", a zero is a value.
METRIC = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("delta", T.LongType()),
    T.StructField("value", T.DoubleType()),
])
METRIC_BATCH = T.ArrayType(METRIC)

# Typed state tables (one per kind), as the database backend keeps them.
GAUGE_TABLE = T.StructType([T.StructField("id", T.StringType(), False),
                            T.StructField("value", T.DoubleType(), False)])
COUNTER_TABLE = T.StructType([T.StructField("id", T.StringType(), False),
                              T.StructField("value", T.LongType(), False)])

# Whole-state document: two maps keyed by name.
STATE_DOC = T.StructType([
    T.StructField("gauges", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("counters", T.MapType(T.StringType(), T.LongType())),
])

AUDIT_EVENT = T.StructType([
    T.StructField("ts", T.LongType()),
    T.StructField("metrics", T.ArrayType(T.StringType())),
    T.StructField("ip_address", T.StringType()),
])

# A raw update or read request made a row.
REQUEST = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("arrival_ts", T.TimestampType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("remote_addr", T.StringType()),
    T.StructField("body", T.StringType()),
])

# Header names the service reads (fixed values).
H_CONTENT_ENCODING = "Content-Encoding"
H_CONTENT_TYPE = "Content-Type"
H_CONTENT_LENGTH = "Content-Length"
H_ACCEPT_ENCODING = "Accept-Encoding"
H_HASH = "HashSHA256"
H_REAL_IP = "X-Real-IP"
H_FORWARDED_FOR = "X-Forwarded-For"
H_USER_AGENT = "User-Agent"
