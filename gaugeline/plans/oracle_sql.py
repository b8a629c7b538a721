"""SQL building blocks for the DuckDB oracles.

They restate, in plain SQL over the same parquet tables, what each Spark
plan must return.  Only the tables are shared; no Spark code is involved.
"""

from gaugeline.functions.signing import hmac_pads

# The update log U (same rules as sources.updates.update_log).
U = """
u AS (
  SELECT event_id AS seq,
         event_id // 10 AS batch_id,
         CAST(event_id % 10 AS INTEGER) AS pos,
         CASE WHEN event_id % 101 = 100 THEN 'histogram'
              WHEN event_id % 2 = 0 THEN 'counter' ELSE 'gauge' END AS type,
         CASE WHEN event_id % 2 = 0 THEN 'hits_' || event_type
              ELSE 'user_' || CAST(user_id AS VARCHAR) END AS id,
         CASE WHEN event_id % 2 = 0 AND event_id % 103 <> 102
              THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS delta,
         CASE WHEN event_id % 2 = 1 AND event_id % 103 <> 102 THEN value END AS value,
         ts, user_id, event_type
  FROM events)"""

# Row outcome in the service's check order.
C = """
c AS (
  SELECT *,
         CASE WHEN type = 'gauge' AND value IS NULL THEN 1
              WHEN type = 'counter' AND delta IS NULL THEN 1
              WHEN type IS NULL OR type NOT IN ('gauge', 'counter') THEN 2
              ELSE 0 END AS err_code
  FROM u)"""

ERR_LABEL = """CASE {c} WHEN 1 THEN 'bad metric value' WHEN 2 THEN 'invalid metric type'
                      WHEN 3 THEN 'decode error' END"""

# Accepted rows: batches without a bad row.
ACC = """
bad AS (SELECT DISTINCT batch_id FROM c WHERE err_code <> 0),
acc AS (SELECT * FROM c WHERE batch_id NOT IN (SELECT batch_id FROM bad))"""

# Folded state of accepted rows.
STATE = """
st AS (
  SELECT type, id,
         CAST(SUM(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
         ARG_MAX(CASE WHEN type = 'gauge' THEN value END, seq) AS value
  FROM acc GROUP BY type, id)"""

# Read requests (same rules as sources.updates.read_requests).
READS = """
rq AS (
  SELECT event_id AS request_id, event_id AS seq,
         CASE WHEN event_id % 64 = 63 THEN 'histogram'
              WHEN event_id % 2 = 0 THEN 'counter' ELSE 'gauge' END AS type,
         CASE WHEN event_id % 16 = 15 THEN 'ghost_' || CAST(user_id AS VARCHAR)
              WHEN event_id % 2 = 0 THEN 'hits_' || event_type
              ELSE 'user_' || CAST(user_id AS VARCHAR) END AS id
  FROM events)"""

MID = "TIMESTAMP '2024-01-16 00:00:00'"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def gauge_text(x: str) -> str:
    """FN-1 in DuckDB SQL: shortest digits of |x| moved to positional form."""
    s = f"CAST(ABS({x}) AS VARCHAR)"
    rx = r"'^([0-9]+)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$'"
    i = f"regexp_extract({s}, {rx}, 1)"
    f = f"regexp_extract({s}, {rx}, 2)"
    e = f"COALESCE(TRY_CAST(NULLIF(regexp_extract({s}, {rx}, 3), '') AS INTEGER), 0)"
    d = f"({i} || {f})"
    p = f"(length({i}) + {e})"
    pos = (f"CASE WHEN {p} <= 0 THEN '0.' || repeat('0', CAST(-{p} AS INTEGER)) || {d} "
           f"WHEN {p} >= length({d}) THEN rpad({d}, CAST({p} AS INTEGER), '0') "
           f"ELSE substring({d}, 1, {p}) || '.' || substring({d}, {p} + 1) END")
    trimmed = (f"CASE WHEN strpos({pos}, '.') > 0 THEN "
               f"regexp_replace(regexp_replace({pos}, '0+$', ''), '\\.$', '') ELSE {pos} END")
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 'NaN' "
            f"WHEN {x} = 'inf'::DOUBLE THEN '+Inf' WHEN {x} = '-inf'::DOUBLE THEN '-Inf' "
            f"ELSE (CASE WHEN {x} < 0 OR (({x}) = 0 AND CAST({x} AS VARCHAR) LIKE '-%') THEN '-' ELSE '' END) "
            f"|| {trimmed} END")


def metric_text(kind: str, delta: str, value: str) -> str:
    return (f"CASE WHEN {kind} = 'gauge' THEN {gauge_text(value)} "
            f"WHEN {kind} = 'counter' THEN CAST({delta} AS VARCHAR) END")


def hmac_sql(body_blob: str, key: str) -> str:
    """HMAC-SHA256 hex in DuckDB from the padded keys."""
    ipad, opad = hmac_pads(key)
    return (f"sha256(unhex('{opad.hex()}') || unhex(sha256(unhex('{ipad.hex()}') || {body_blob})))")


# Batch bodies rebuilt as JSON text (element order = pos; null fields
# omitted; the same two defects as sources.updates.batch_bodies).
BODIES = """
el AS (
  SELECT batch_id, pos, seq, user_id, ts, delta, id,
         '{"id":"' || id || '","type":"' || type || '"'
         || COALESCE(',"delta":' || CAST(delta AS VARCHAR), '')
         || COALESCE(',"value":' || CAST(value AS VARCHAR), '') || '}' AS e
  FROM u),
bb AS (
  SELECT batch_id, '[' || string_agg(e, ',' ORDER BY pos) || ']' AS body0,
         bool_or(delta IS NOT NULL) AS has_delta, MIN(seq) AS first_seq, MIN(ts) AS arrival_ts,
         MIN(user_id) AS user_id
  FROM el GROUP BY batch_id),
b AS (
  SELECT *, CASE WHEN batch_id % 17 = 16 THEN substring(body0, 1, length(body0) - 1)
                 WHEN batch_id % 17 = 15 THEN regexp_replace(body0, '"delta":(-?[0-9]+)', '"delta":"\\1"', 'g')
                 ELSE body0 END AS body,
         (batch_id % 17 = 16 OR (batch_id % 17 = 15 AND has_delta)) AS undecodable
  FROM bb)"""


def requests_cte(key: str) -> str:
    """Request envelopes over BODIES (same rules as request_envelopes)."""
    right = hmac_sql("encode(body)", key)
    wrong = hmac_sql("encode(body || ' ')", key)
    return f"""
req AS (
  SELECT *,
         '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.1:' || CAST(1024 + first_seq % 1000 AS VARCHAR) AS remote_addr,
         CASE WHEN batch_id % 3 = 0 THEN '192.168.0.' || CAST(batch_id % 250 AS VARCHAR) END AS real_ip,
         CASE WHEN batch_id % 3 = 1 THEN ' 172.16.0.' || CAST(batch_id % 250 AS VARCHAR) || ', 10.9.9.9' END AS xff,
         {right} AS right_hash,
         CASE WHEN batch_id % 5 <> 0 THEN {right} WHEN batch_id % 10 = 0 THEN {wrong} END AS hash
  FROM b)"""


_SP = r"[\s\x{85}\p{Z}]"


def client_ip_sql(real: str, xff: str, remote: str) -> str:
    hop = f"split_part(COALESCE({xff}, ''), ',', 1)"
    fromh = f"CASE WHEN COALESCE({real}, '') <> '' THEN {real} ELSE {hop} END"
    ip = f"CASE WHEN {fromh} <> '' THEN {fromh} ELSE regexp_replace(COALESCE({remote}, ''), ':[^:]*$', '') END"
    return f"regexp_replace({ip}, '^{_SP}+|{_SP}+$', '', 'g')"
