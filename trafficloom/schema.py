"""Explicit schemas of the traffic tables; nothing is inferred."""

from __future__ import annotations

PAIRS = "array<struct<name: string, value: string>>"

EVENT_TYPES = ("CLIENT_REQUEST", "UPSTREAM_REQUEST", "REQUEST_BODY", "UPSTREAM_RESPONSE", "RESPONSE_BODY", "CLIENT_RESPONSE", "END")

EVENT_SCHEMA = (
    "req_id string, seq bigint, event_type string, event_time timestamp, shard int, journal_level string, start_line string, "
    f"headers {PAIRS}, status int, client_ip string, client_ip_source string, body binary, client_start_ns bigint, client_end_ns bigint, "
    "proxy_start_ns bigint, proxy_first_byte_ns bigint, proxy_end_ns bigint, request_header_bytes bigint, request_body_bytes bigint, "
    f"response_header_bytes bigint, response_body_bytes bigint, request_crc bigint, response_crc bigint, attributes {PAIRS}"
)

END_COLUMNS = (
    "client_start_ns", "client_end_ns", "proxy_start_ns", "proxy_first_byte_ns", "proxy_end_ns", "request_header_bytes", "request_body_bytes",
    "response_header_bytes", "response_body_bytes", "request_crc", "response_crc", "attributes",
)

ROUTE_SCHEMA = "ordinal int, route_id string, rule string, targets array<string>, fallback_route_id string"
POLICY_SCHEMA = "route_id string, direction string, base_level string, ordinal int, override_key string, override_level string"
NETWORK_SCHEMA = "network_id string, cidr string"
PROBE_SCHEMA = "target string, ts timestamp, ok boolean"
CONFIG_SCHEMA = "version string, valid_from timestamp, ordinal int, route_id string, rule string"

LEVELS = ("NONE", "METADATA", "HEADERS", "FULL")  # in ascending order
