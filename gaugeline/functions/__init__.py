"""Column expressions (all JVM-side; no Python UDFs)."""

from gaugeline.functions.text import (format_gauge, format_counter, format_metric_value,
                                      mask_hash, truncate_bytes, byte_prefix_hex)
from gaugeline.functions.numbers import (parse_gauge_text, parse_counter_text, GAUGE_TEXT_RE,
                                         COUNTER_TEXT_RE)
from gaugeline.functions.signing import hmac_sha256_hex, hmac_pads
from gaugeline.functions.net import client_ip, header

__all__ = [
    "format_gauge", "format_counter", "format_metric_value", "mask_hash", "truncate_bytes",
    "byte_prefix_hex", "parse_gauge_text", "parse_counter_text", "GAUGE_TEXT_RE",
    "COUNTER_TEXT_RE", "hmac_sha256_hex", "hmac_pads", "client_ip", "header",
]
