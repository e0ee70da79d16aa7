"""Functions for use in SQL, by the same rules as in ``text`` (entropy by one sort of the characters): ``register(spark)`` creates them as temporary SQL functions, without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import MIN_ENTROPY, REDACTED, ROUTE_CUES, TOKEN_RUN


def _cases() -> str:
    return "CASE " + " ".join(f"WHEN q RLIKE r'(?i){pattern}' THEN '{name}'" for name, pattern in ROUTE_CUES) + " END"


FUNCTIONS = {
    "split_identifier(name STRING) RETURNS STRING": r"trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(name, r'[_\-]+', ' '), r'([a-z0-9])([A-Z])', '$1 $2'), r'([A-Z])([A-Z][a-z])', '$1 $2')), r'\s+', ' '))",
    "shannon_entropy(s STRING) RETURNS DOUBLE": """if(char_length(s) > 0, log2(CAST(char_length(s) AS DOUBLE)) - aggregate(array_sort(filter(split(s, ''), c -> c <> '')),
        named_struct('last', '', 'k', 0D, 'sum', 0D),
        (a, c) -> named_struct('last', c, 'k', if(c = a.last, a.k + 1D, 1D), 'sum', a.sum + if(c = a.last, (a.k + 1D) * log2(a.k + 1D) - a.k * log2(greatest(a.k, 1D)), 0D)),
        a -> a.sum) / char_length(s), 0D)""",
    "route_question(q STRING) RETURNS STRING": _cases(),
    "token_estimate(s STRING) RETURNS BIGINT": "greatest(1L, CAST(floor(char_length(s) / 4) AS BIGINT))",
    "redact_entropy(s STRING) RETURNS STRING": f"array_join(zip_with(split(s, r'{TOKEN_RUN}', -1), transform(regexp_extract_all(s, r'({TOKEN_RUN})', 1), r -> if(r RLIKE '[0-9]' AND shannon_entropy(r) >= {MIN_ENTROPY}, '{REDACTED}', r)), (g, r) -> concat(g, coalesce(r, ''))), '')",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions that this session's SQL accepts; gives their names."""
    made = []
    for head, body in FUNCTIONS.items():
        if head.startswith("redact_entropy"):  # a function called in a lambda must be written out there
            inner = FUNCTIONS["shannon_entropy(s STRING) RETURNS DOUBLE"].replace("split(s, '')", "split(r, '')").replace("char_length(s)", "char_length(r)")
            body = body.replace("shannon_entropy(r)", f"({inner})")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        made.append(head.split("(")[0])
    return made
