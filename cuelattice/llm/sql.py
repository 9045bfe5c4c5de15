"""DuckDB SQL of those queries that SQL can express over whole tables."""

_P3 = """
WITH c AS (SELECT DISTINCT cut_id, track_key, round(time_seconds * 10000.0, 0)::BIGINT AS t, round(tolerance_seconds * 10000.0, 0)::BIGINT AS tol
           FROM cut_record WHERE track_key <> '' AND isfinite(time_seconds) AND isfinite(tolerance_seconds)),
e AS (SELECT track_key, round(time_seconds * 10000.0, 0)::BIGINT AS t, min(event_id) AS event_id
      FROM music_event WHERE track_key <> '' AND isfinite(time_seconds) GROUP BY 1, 2),
b AS (SELECT c.cut_id, c.t - e.t AS d, e.event_id, c.tol, 0 AS later FROM c ASOF JOIN e ON c.track_key = e.track_key AND c.t >= e.t),
a AS (SELECT c.cut_id, e.t - c.t AS d, e.event_id, c.tol, 1 AS later FROM c ASOF JOIN e ON c.track_key = e.track_key AND c.t <= e.t),
u AS (SELECT *, row_number() OVER (PARTITION BY cut_id ORDER BY d, later, event_id) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE d <= tol)
SELECT cut_id, event_id FROM u WHERE rn = 1
"""

SQL = {"p3_found": _P3}
