"""The library under SQL names (U02): temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = {
    "ws_upper": ("t STRING", "STRING", "upper(coalesce(t, ''))"),
    "ws_value": (
        "t STRING",
        "DOUBLE",
        "CASE WHEN trim(coalesce(t, '')) = '' THEN 0D WHEN endswith(trim(t), '%') THEN"
        " try_cast(replace(replace(trim(t), ',', ''), '%', '') AS DOUBLE) / 100 ELSE try_cast(replace(trim(t), ',', '') AS DOUBLE) END",
    ),
    "ws_mod": ("x DOUBLE, y DOUBLE", "DOUBLE", "x - y * floor(try_divide(x, y))"),
    "ws_pmt": (
        "rate DOUBLE, nper DOUBLE, pv DOUBLE",
        "DOUBLE",
        "CASE WHEN rate = 0 THEN try_divide(-pv, nper) ELSE try_divide(-pv * power(1 + rate, nper) * rate, power(1 + rate, nper) - 1) END",
    ),
    "ws_sln": ("cost DOUBLE, salvage DOUBLE, life DOUBLE", "DOUBLE", "try_divide(cost - salvage, life)"),
    "ws_effect": ("nominal DOUBLE, npery INT", "DOUBLE", "CASE WHEN npery >= 1 THEN power(1 + nominal / npery, npery) - 1 END"),
    "ws_textbefore": (
        "t STRING, d STRING",
        "STRING",
        "CASE WHEN d = '' THEN '' WHEN contains(t, d) THEN substring_index(t, d, 1) END",
    ),
    "ws_serial": (
        "d DATE",
        "INT",
        "datediff(d, DATE'1899-12-30') - CASE WHEN datediff(d, DATE'1899-12-30') <= 60 THEN 1 ELSE 0 END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, returns, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return list(DEFINITIONS)
