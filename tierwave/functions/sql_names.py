"""The library's expressions as names in Spark SQL: table functions for lateral joins, and functions of moments."""

from __future__ import annotations

from pyspark.sql import SparkSession

PART = "STRUCT<n: DOUBLE, sum: DOUBLE, min: DOUBLE, max: DOUBLE, m1: DOUBLE, m2: DOUBLE, m3: DOUBLE, m4: DOUBLE>"
MOMENTS = f"ARRAY<{PART}>"

#: Each is SQL, so calls are expanded in the plan and run as generated code.
FUNCTIONS = {
    # The positions of an interval.
    "rasterize": "(start_at BIGINT, end_at BIGINT) RETURNS TABLE (pos BIGINT) RETURN SELECT col FROM (SELECT explode(CASE WHEN start_at < end_at THEN sequence(start_at, end_at - 1) ELSE array() END) AS col)",
    # The tiles that an interval touches, and its positions in each.
    "tiles_of": """(start_at BIGINT, end_at BIGINT, width BIGINT) RETURNS TABLE (tile BIGINT, n BIGINT)
        RETURN SELECT t, least(end_at, (t + 1) * width) - greatest(start_at, t * width) FROM (SELECT explode(CASE WHEN start_at < end_at THEN sequence(start_at div width, (end_at - 1) div width) ELSE array() END) AS t)""",
    # Operations of a CIGAR where they lie, if clips move on as matches do; insertions and padding don't move.
    "cigar_segments": """(pos BIGINT, cigar ARRAY<STRUCT<op: INT, len: INT>>) RETURNS TABLE (number INT, op INT, start_at BIGINT, end_at BIGINT)
        RETURN SELECT col.number, col.op, col.start_at, col.end_at FROM (SELECT explode(transform(cigar, (c, i) -> named_struct('number', i, 'op', c.op,
            'start_at', pos + aggregate(slice(cigar, 1, i), 0L, (a, x) -> a + CASE WHEN x.op IN (1, 6) THEN 0 ELSE x.len END),
            'end_at', pos + aggregate(slice(cigar, 1, i + 1), 0L, (a, x) -> a + CASE WHEN x.op IN (1, 6) THEN 0 ELSE x.len END)))) AS col)""",
    # Number of the bin of sorted edges that a value lies in; null outside.
    "bin_of": "(value DOUBLE, edges ARRAY<DOUBLE>) RETURNS INT RETURN CASE WHEN value >= edges[0] AND value < edges[size(edges) - 1] THEN size(filter(edges, e -> e <= value)) - 1 END",
    # Moments of the union of windows, from theirs.
    "merge_moments": f"""(parts {MOMENTS}) RETURNS {PART} RETURN
        aggregate(parts, named_struct('n', 0D, 'sum', 0D, 'min', CAST(NULL AS DOUBLE), 'max', CAST(NULL AS DOUBLE), 'm1', 0D, 'm2', 0D, 'm3', 0D, 'm4', 0D), (a, b) -> CASE WHEN b.n = 0 THEN a WHEN a.n = 0 THEN b ELSE named_struct(
            'n', a.n + b.n, 'sum', a.sum + b.sum, 'min', least(a.min, b.min), 'max', greatest(a.max, b.max), 'm1', a.m1 + (b.m1 - a.m1) * b.n / (a.n + b.n),
            'm2', a.m2 + b.m2 + pow(b.m1 - a.m1, 2) * a.n * b.n / (a.n + b.n),
            'm3', a.m3 + b.m3 + pow(b.m1 - a.m1, 3) * a.n * b.n * (a.n - b.n) / pow(a.n + b.n, 2) + 3 * (b.m1 - a.m1) * (a.n * b.m2 - b.n * a.m2) / (a.n + b.n),
            'm4', a.m4 + b.m4 + pow(b.m1 - a.m1, 4) * a.n * b.n * (a.n * a.n - a.n * b.n + b.n * b.n) / pow(a.n + b.n, 3)
                + 6 * pow(b.m1 - a.m1, 2) * (a.n * a.n * b.m2 + b.n * b.n * a.m2) / pow(a.n + b.n, 2) + 4 * (b.m1 - a.m1) * (a.n * b.m3 - b.n * a.m3) / (a.n + b.n)) END)""",
    # Mean, sample deviation, skew and excess kurtosis; 0, 0 and -3 where they aren't defined.
    "standardize": f"""(p {PART}) RETURNS STRUCT<mean: DOUBLE, std: DOUBLE, skew: DOUBLE, kurt: DOUBLE> RETURN named_struct('mean', p.m1, 'std', CASE WHEN p.m2 > 0 AND p.n > 1 THEN sqrt(p.m2 / (p.n - 1)) ELSE 0D END,
        'skew', CASE WHEN p.m2 > 0 THEN sqrt(p.n) * p.m3 / pow(p.m2, 1.5) ELSE 0D END, 'kurt', CASE WHEN p.m2 > 0 THEN p.n * p.m4 / (p.m2 * p.m2) - 3 ELSE -3D END)""",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the names known to spark.sql() in this session."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")
    return sorted(FUNCTIONS)
