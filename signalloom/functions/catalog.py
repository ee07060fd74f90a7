"""The functions that users name in SQL: SQL functions, one Arrow function, and a table function.

``register(spark)`` makes them temporary functions of the session. Spark inlines SQL functions into the query, so they are planned and compiled like what is written out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .hashing import OFFSET, hash_function

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"

#: name(parameters) RETURNS type -> body, in the order in which they use each other.
FUNCTIONS = {
    "truncate_utf8(value STRING, bytes INT) RETURNS STRING": "CASE WHEN octet_length(value) <= bytes THEN value ELSE decode(substring(encode(value, 'UTF-8'), 1, array_max(filter(sequence(0, greatest(bytes, 0)), k -> k > bytes - 4 AND (k = 0 OR hex(substring(encode(value, 'UTF-8'), k + 1, 1)) NOT RLIKE '^[89AB]')))), 'UTF-8') END",
    "normalize_domain(name STRING) RETURNS STRING": rf"CASE WHEN octet_length(regexp_replace(trim(name), r'\.+$', '')) <= 253 AND lower(regexp_replace(trim(name), r'\.+$', '')) RLIKE r'^{_LABEL}(\.{_LABEL})*$' THEN lower(regexp_replace(trim(name), r'\.+$', '')) END",
    "glob_match(pattern STRING, value STRING) RETURNS BOOLEAN": r"CASE WHEN pattern RLIKE '[*?]' THEN value RLIKE concat(r'(?s)^\Q', replace(replace(replace(pattern, r'\E', r'\E\\E\Q'), '*', r'\E.*\Q'), '?', r'\E.\Q'), r'\E$') ELSE value = pattern END",
    "container_of_path(path STRING) RETURNS STRING": "CASE WHEN path RLIKE 'docker|containerd|crio|cri-o|libpod|kubepods' THEN nullif(regexp_extract(path, '(?<![0-9a-fA-F])([0-9a-fA-F]{64})(?![0-9a-fA-F])', 1), '') END",
    "ipv4_is_external(address STRING) RETURNS BOOLEAN": rf"coalesce(address RLIKE r'^{_OCTET}(\.{_OCTET}){{3}}$' AND address NOT RLIKE r'^(10|127|22[4-9]|23[0-9]|192\.168|169\.254|172\.(1[6-9]|2[0-9]|3[01]))\.' AND address NOT IN ('255.255.255.255', '0.0.0.0'), false)",
    "ipv6_words(side STRING) RETURNS ARRAY<STRING>": "CASE WHEN coalesce(side, '') = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split(side, ':') END",
    "ipv6_undotted(address STRING) RETURNS STRING": rf"CASE WHEN address RLIKE r'^.*:{_OCTET}(\.{_OCTET}){{3}}$' THEN lower(concat(regexp_extract(address, '^(.*:)[0-9.]+$', 1), array_join(transform(array(1, 3), k -> concat_ws('', transform(array(k, k + 1), i -> lpad(hex(CAST(split_part(regexp_extract(address, '([0-9.]+)$', 1), '.', i) AS INT)), 2, '0')))), ':'))) ELSE lower(address) END",
    "ipv6_filled(left ARRAY<STRING>, right ARRAY<STRING>, sides INT) RETURNS ARRAY<STRING>": "CASE WHEN sides = 2 AND size(left) + size(right) < 8 THEN concat(left, array_repeat('0', 8 - size(left) - size(right)), right) WHEN sides = 1 AND size(left) = 8 THEN left END",
    "ipv6_digits(groups ARRAY<STRING>) RETURNS STRING": "CASE WHEN forall(groups, g -> g RLIKE '^[0-9a-f]{1,4}$') THEN array_join(transform(groups, g -> lpad(g, 4, '0')), '') END",
    "ipv6_groups(sides ARRAY<STRING>) RETURNS STRING": "ipv6_digits(ipv6_filled(ipv6_words(sides[0]), ipv6_words(get(sides, 1)), size(sides)))",
    "ipv6_is_external(digits STRING) RETURNS BOOLEAN": f"CASE WHEN digits LIKE '{'0' * 20}ffff%' THEN ipv4_is_external(array_join(transform(array(25, 27, 29, 31), k -> conv(substring(digits, k, 2), 16, 10)), '.')) ELSE digits NOT RLIKE '^(0{{31}}[01]$|ff|f[cd]|fe[89ab])' END",
    "is_external_address(address STRING) RETURNS BOOLEAN": "CASE WHEN address LIKE '%:%' THEN coalesce(ipv6_is_external(ipv6_groups(split(ipv6_undotted(address), '::'))), false) ELSE ipv4_is_external(address) END",
    "traceparent_fault(parts ARRAY<STRING>) RETURNS STRING": "CASE WHEN parts IS NULL OR transform(parts, p -> length(p)) <> array(2, 32, 16, 2) THEN 'malformed' WHEN array_join(parts, '') NOT RLIKE '^[0-9a-f]*$' THEN 'invalid_hex' WHEN parts[0] = 'ff' THEN 'reserved_version' WHEN parts[1] RLIKE '^0+$' THEN 'all_zero_trace_id' WHEN parts[2] RLIKE '^0+$' THEN 'all_zero_span_id' END",
    "traceparent(value STRING) RETURNS TABLE(version STRING, trace_id STRING, span_id STRING, flags STRING, reason STRING)": "SELECT CASE WHEN reason IS NULL THEN parts[0] END, CASE WHEN reason IS NULL THEN parts[1] END, CASE WHEN reason IS NULL THEN parts[2] END, CASE WHEN reason IS NULL THEN parts[3] END, reason FROM (SELECT parts, traceparent_fault(parts) AS reason FROM (SELECT split(value, '-') AS parts))",
}


def register(spark: SparkSession) -> list[str]:
    """Registers the functions and returns their names: those of ``FUNCTIONS``, and ``fnv1a64(value)``, which runs on Arrow batches as its product wraps."""
    names = []
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    spark.udf.register("fnv1a64", hash_function(OFFSET))
    return [*names, "fnv1a64"]
