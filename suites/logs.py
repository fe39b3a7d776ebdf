"""Guard, log and run checks."""
from pyspark.sql import functions as F

from suites import check
from voxelspark.functions import guarding
from voxelspark.operators import guard, runs

PRIVATE = ["quuxw\\w+", "purchas"]


def _q(text):
    return text.replace("'", "''")


_SHAPE = "case " + " ".join(f"when regexp_matches(what, '{_q(p)}') then '{_q(w)}'" for p, w in guarding.SHAPES) + " end"
_ALLOW = "regexp_matches(what, '" + _q("|".join(f"(?:{p})" for p in guarding.ALLOWED)) + "')"


def _hits(private):
    secret = "regexp_matches(what, '(?i)" + "|".join(f"(?:{p})" for p in private) + "')" if private else "false"
    return f"""w AS (SELECT line_id, path, 'path' AS part, coalesce(path, '') AS what FROM guard_lines UNION ALL SELECT line_id, path, 'text', coalesce(line, '') FROM guard_lines),
 hit AS (SELECT line_id, part, path, case when {secret} then 'a word from the private list' when {_ALLOW} then null else {_SHAPE} end AS reason,
  case when {secret} then '(not shown)' else trim(what) end AS snippet FROM w)"""


@check("x01_guard_text", f"WITH {_hits([])} SELECT * FROM hit WHERE reason IS NOT NULL")
def _(fx):
    return guard.guard_text(fx.guard_lines)


@check("x02_guard_private", f"WITH {_hits(PRIVATE)} SELECT * FROM hit WHERE reason = 'a word from the private list'")
def _(fx):
    return guard.guard_private(fx.guard_lines, PRIVATE)


@check("x03_added_lines", """WITH e AS (SELECT diff_id, seq, line, case when line LIKE '+++ %' then seq when line LIKE 'diff --git%' then seq end AS pos,
  case when line LIKE '+++ b/%' then substring(line, 7) when line LIKE '+++ %' then substring(line, 5) end AS name FROM diff_lines),
 g AS (SELECT *, max(pos) OVER (PARTITION BY diff_id ORDER BY seq) AS head FROM e)
 SELECT g.diff_id, g.seq, h.name AS path, substring(g.line, 2) AS line FROM g LEFT JOIN e h ON h.seq = g.head WHERE g.line LIKE '+%' AND g.line NOT LIKE '+++%'""")
def _(fx):
    return guard.added_lines(fx.diff_lines, bucket_rows=512)


@check("x04_guard_report", f"""WITH {_hits(PRIVATE)} SELECT line_id, coalesce(path, '(commit message)') AS path, reason, snippet, true AS refused FROM hit
 WHERE reason IS NOT NULL""")
def _(fx):
    return guard.guard_report(guard.guard_text(fx.guard_lines, PRIVATE))


@check("x05_run_progress", r"""WITH e AS (SELECT run_id, seq, trim(line) AS s, case when trim(line) LIKE 'reading:%' then 'read' when trim(line) LIKE 'computing on:%' then 'net'
   when trim(line) LIKE 'surfaces prepared%' then 'mesh' when trim(line) LIKE 'separating teeth%' then 'teeth' end AS opens FROM run_log),
 p AS (SELECT *, last_value(opens IGNORE NULLS) OVER w AS phase, max(case when opens = 'mesh' then seq end) OVER w AS m0, max(case when opens = 'teeth' then seq end) OVER w AS t0
  FROM e WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
 c AS (SELECT *, phase = 'mesh' AND opens IS NULL AND regexp_matches(s, '^[A-Z][\w ]+: ') AS ism, phase = 'teeth' AND regexp_matches(s, '^(upper|lower) arch') AS isa,
  regexp_extract(s, '^tile (\d+)/(\d+)', 1) AS ti, regexp_extract(s, '^tile (\d+)/(\d+)', 2) AS tn FROM p),
 d AS (SELECT *, count(*) FILTER (ism) OVER (PARTITION BY run_id, m0 ORDER BY seq) AS meshes, count(*) FILTER (isa) OVER (PARTITION BY run_id, t0 ORDER BY seq) AS arches FROM c),
 f AS (SELECT *, case when opens = 'read' then 0.01 when s LIKE 'resampled to%' or opens = 'net' then 0.05 when ti <> '' and phase = 'net' then 0.05 + 0.65::DOUBLE*ti::INT/greatest(tn::INT, 1)
   when opens = 'mesh' then 0.7 when ism then 0.7 + 0.2::DOUBLE*least(1, meshes/9.0::DOUBLE) when opens = 'teeth' then 0.9 when isa then 0.9 + 0.09::DOUBLE*arches/2
   when ti <> '' and phase = 'teeth' then 0.9 + 0.09::DOUBLE*(arches + ti::DOUBLE/greatest(tn::INT, 1))/2 when s LIKE 'done in%' then 1 end AS fac FROM d)
 SELECT run_id, seq, phase, round(last_value(fac IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq), 6) AS factor FROM f""")
def _(fx):
    return runs.run_progress(fx.run_log, bucket_rows=16).withColumn("factor", F.round("factor", 6))


@check("x06_first_error", """SELECT run_id, trim(substring(arg_min(line, seq) FILTER (line LIKE 'ERROR:%'), 7)) AS error, NULL::INT AS exit_code FROM run_log GROUP BY run_id""")
def _(fx):
    return runs.first_error(fx.run_log)


@check("x07_settled_value", """WITH c AS (SELECT user_id AS key, ts, event_id, (event_id % 101)::DOUBLE AS value FROM events),
 n AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS nx FROM c),
 s AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY ts, event_id) AS applied FROM n WHERE nx IS NULL OR epoch(nx) - epoch(ts) >= 3600)
 SELECT key, ts, value FROM s WHERE abs(value - coalesce(applied, 50)) >= 0.05""")
def _(fx):
    changes = fx.table("events").selectExpr("user_id AS key", "ts", "event_id AS seq", "event_id % 101 AS value")
    return runs.settled_value(changes, 3600.0)


@check("x08_number_runs", """WITH old AS (SELECT c_nationkey AS g, max(c_custkey % 50) AS top FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_nationkey)
 SELECT c_nationkey AS "group", c_custkey AS run_id, coalesce(top, 0) + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS number
 FROM customer LEFT JOIN old ON g = c_nationkey WHERE c_custkey % 3 <> 0""")
def _(fx):
    c = fx.table("customer")
    new = c.filter("c_custkey % 3 <> 0").selectExpr("c_nationkey AS group", "c_custkey AS run_id")
    old = c.filter("c_custkey % 3 = 0").selectExpr("c_nationkey AS group", "c_custkey % 50 AS number")
    return runs.number_runs(new, old, F.floor(F.col("run_id") / 1024), ["run_id"]).select("group", "run_id", "number")
