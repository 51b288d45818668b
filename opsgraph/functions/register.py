"""Functions for SQL: approx_tokens, bm25_idf, out_of_hours, stem, and the table functions terms and pack."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from opsgraph.functions.tables import Pack

SQL = {
    "approx_tokens": ("t STRING", "INT", "greatest(1, cast(length(t) div 4 AS INT))"),
    "bm25_idf": ("n BIGINT, df BIGINT", "DOUBLE", "ln(1 + (n - df + 0.5D) / (df + 0.5D))"),
    # functions.text.stem: plural endings first, then those of the past and the gerund where a vowel stays.
    "stem_plural": ("t STRING", "STRING", "CASE WHEN endswith(t, 'sses') OR endswith(t, 'ies') THEN left(t, length(t) - 2) WHEN endswith(t, 's') AND NOT endswith(t, 'ss') THEN left(t, length(t) - 1) ELSE t END"),
    "stem_past": ("t STRING", "STRING", "CASE WHEN t RLIKE '^.*[aeiou].*eed$' AND length(t) >= 6 THEN left(t, length(t) - 2) WHEN t RLIKE '^.*[aeiou].*ed$' AND length(t) >= 5 THEN left(t, length(t) - 2) WHEN t RLIKE '^.*[aeiou].*ing$' AND length(t) >= 6 THEN left(t, length(t) - 3) ELSE t END"),
    "stem": ("t STRING", "STRING", "CASE WHEN length(t) <= 3 OR t RLIKE '[0-9]' THEN t ELSE coalesce(nullif(stem_past(stem_plural(t)), ''), 'x') END"),
    "out_of_hours": ("at TIMESTAMP_NTZ", "BOOLEAN", "weekday(at) >= 5 OR hour(at) < 8 OR hour(at) >= 18"),
}


@udtf(returnType="place int, term string")
class Terms:
    """terms(text): a row a token; SELECT ... FROM t, LATERAL terms(t.text)."""

    def eval(self, text: str):
        yield from enumerate(re.findall("[a-z0-9_]+", (text or "").lower()))


def register(spark: SparkSession) -> None:
    """Makes them known to a session, until it ends."""
    for name, (arguments, kind, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("terms", Terms)
    spark.udtf.register("pack", Pack)
