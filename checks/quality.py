"""Quality control."""

from pyspark.sql import functions as F

from checks.base import AGG, VALID
from checks.registry import register
from pluvio.operators import qc, summary
from pluvio.plans import refresh
from pluvio.schema import KEY
from pluvio.session import stored

S = "station_id, variable_id"


def chain(keys: str, thr: str, limits: list[str], more: str, any_text: str) -> str:
    on = f"AND {{a}}.variable_id = k.variable_id {more}"
    parts = []
    for a, owner, iv in (
        ("a", "k.station_id", "a.ivl = k.ivl"),
        ("b", "k.station_id", "b.ivl IS NULL"),
        ("c", "s.reference_station_id", "c.ivl = k.ivl"),
        ("d", "s.reference_station_id", "d.ivl IS NULL"),
    ):
        parts.append(f"LEFT JOIN {thr} {a} ON {a}.station_id = {owner} AND {iv} {on.format(a=a)}")
    hits = ", ".join(
        f"CASE WHEN a.station_id IS NOT NULL THEN a.{c} WHEN b.station_id IS NOT NULL THEN b.{c} "
        f"WHEN c.station_id IS NOT NULL THEN c.{c} ELSE d.{c} END AS h_{c}"
        for c in limits
    )
    return f"""SELECT k.*, s.is_automatic, v.* EXCLUDE (id), {hits},
      CASE WHEN a.station_id IS NOT NULL THEN 'Custom station Threshold' WHEN b.station_id IS NOT NULL THEN '{any_text}'
        WHEN c.station_id IS NOT NULL OR d.station_id IS NOT NULL THEN 'Reference station threshold' END AS src
    FROM {keys} k LEFT JOIN station s ON s.id = k.station_id LEFT JOIN variable v ON v.id = k.variable_id {' '.join(parts)}"""


GLOBAL = "CASE WHEN is_automatic THEN 'Global threshold (Automatic)' WHEN NOT is_automatic THEN 'Global threshold (Manual)' END"
RK = f"SELECT DISTINCT {S}, seconds AS ivl, CAST(month(datetime) AS INT) AS month FROM obs_regular"
RC = chain("rk", "range_thr", ["range_min", "range_max"], "AND {a}.month = k.month", "Custom station threshold")
RANGE = f"""SELECT {S}, ivl AS "interval", month,
  CASE WHEN src IS NOT NULL THEN h_range_min WHEN is_automatic THEN range_min_hourly WHEN NOT is_automatic THEN range_min END AS range_min,
  CASE WHEN src IS NOT NULL THEN h_range_max WHEN is_automatic THEN range_max_hourly WHEN NOT is_automatic THEN range_max END AS range_max,
  coalesce(src, {GLOBAL}) AS range_description FROM rchain"""
SK = f"SELECT DISTINCT {S}, seconds AS ivl FROM obs_regular"
SC = chain("sk", "step_thr", ["step_min", "step_max"], "", "Custom station Threshold")
STEP = f"""SELECT {S}, ivl AS "interval", CASE WHEN src IS NOT NULL THEN h_step_min ELSE -gs END AS step_min,
  CASE WHEN src IS NOT NULL THEN h_step_max ELSE gs END AS step_max,
  coalesce(src, CASE WHEN gs IS NOT NULL THEN {GLOBAL} END) AS step_description
  FROM (SELECT *, CASE WHEN is_automatic THEN step_hourly WHEN NOT is_automatic THEN step END AS gs FROM schain)"""
WINDOW = """CASE WHEN is_automatic IS NULL THEN 3600 WHEN is_automatic THEN coalesce(persistence_window_hourly, 1) * 3600
  ELSE coalesce(persistence_window, 96) * 3600 END"""
MODAL = f"""SELECT {S}, CAST(abs(gap) AS INT) AS ivl FROM (
    SELECT {S}, gap, count(*) AS n FROM (SELECT {S}, coalesce(CAST(epoch(datetime - lag(datetime) OVER (PARTITION BY {S} ORDER BY datetime)) AS BIGINT), 0) AS gap
      FROM obs_regular) GROUP BY 1, 2, 3)
  QUALIFY row_number() OVER (PARTITION BY {S} ORDER BY n DESC, gap) = 1"""
PK = f"""SELECT m.*, {WINDOW} AS wnd FROM modal m LEFT JOIN station s ON s.id = m.station_id LEFT JOIN variable v ON v.id = m.variable_id"""
PC = chain("pk", "persist_thr", ["minimum_variance"], "AND {a}.wnd = k.wnd", "Custom station Threshold")
PERSIST = f"""SELECT {S}, ivl, wnd, CASE WHEN ivl <> 0 AND wnd <> 0 THEN
    CASE WHEN src IS NOT NULL THEN h_minimum_variance WHEN is_automatic THEN persistence_hourly WHEN NOT is_automatic THEN persistence END END AS persist_min,
  CASE WHEN ivl <> 0 AND wnd <> 0 THEN coalesce(src, {GLOBAL}) END AS persist_description FROM pchain"""
RCTE = dict(rk=RK, rchain=RC, rlim=RANGE)
SCTE = dict(sk=SK, schain=SC, slim=STEP)
PCTE = dict(modal=MODAL, pk=PK, pchain=PC, plim=PERSIST)


def range_keys(t):
    return (
        t.obs_regular()
        .select("station_id", "variable_id", F.col("seconds").alias("interval"), F.month("datetime").alias("month"))
        .distinct()
    )


def step_keys(t):
    return t.obs_regular().select("station_id", "variable_id", F.col("seconds").alias("interval")).distinct()


def limits(t):
    return qc.persist_limits(t.obs_regular(), t.persist_thr(), t.station(), t.variable())


register(
    "resolve_range_threshold",
    lambda t: qc.resolve_range_threshold(range_keys(t), t.range_thr(), t.station(), t.variable()),
    "SELECT * FROM rlim",
    **RCTE,
)
register(
    "resolve_step_threshold",
    lambda t: qc.resolve_step_threshold(step_keys(t), t.step_thr(), t.station(), t.variable()),
    "SELECT * FROM slim",
    **SCTE,
)
register(
    "resolve_persist_threshold",
    limits,
    """SELECT station_id, variable_id, ivl AS "interval", wnd AS "window", persist_min, persist_description FROM plim""",
    **PCTE,
)
NAMES = ["station_id", "variable_id", "datetime", "measured"]
RTEST = """SELECT o.*, CASE WHEN l.range_min IS NULL OR l.range_max IS NULL THEN 1 WHEN o.measured >= l.range_min AND o.measured <= l.range_max THEN 4 ELSE 3 END AS qc_range_quality_flag,
  CASE WHEN l.range_min IS NULL OR l.range_max IS NULL THEN 'Threshold not found' ELSE l.range_description END AS qc_range_description
  FROM obs_regular o LEFT JOIN rlim l ON l.station_id = o.station_id AND l.variable_id = o.variable_id AND l."interval" = o.seconds AND l.month = month(o.datetime)"""
DIFF = """SELECT *, measured - lag(measured) OVER w AS diff_value, coalesce(CAST(epoch(datetime - lag(datetime) OVER w) AS BIGINT), 0) AS diff_seconds
  FROM obs_regular WINDOW w AS (PARTITION BY station_id, variable_id, seconds, month(datetime) ORDER BY datetime)"""
STEST = """SELECT o.* EXCLUDE (diff_value, diff_seconds),
  CASE WHEN l.step_min IS NULL OR l.step_max IS NULL THEN 1 WHEN o.seconds <> o.diff_seconds THEN 1
    WHEN o.diff_value >= l.step_min AND o.diff_value <= l.step_max THEN 4 ELSE 3 END AS qc_step_quality_flag,
  CASE WHEN l.step_min IS NULL OR l.step_max IS NULL THEN 'Threshold not found' WHEN o.seconds <> o.diff_seconds THEN 'Consecutive value not present'
    ELSE l.step_description END AS qc_step_description
  FROM sdiff o LEFT JOIN slim l ON l.station_id = o.station_id AND l.variable_id = o.variable_id AND l."interval" = o.seconds"""
BOTH = """SELECT s.*, r.qc_range_quality_flag, r.qc_range_description,
  CASE WHEN s.qc_step_quality_flag = 3 OR r.qc_range_quality_flag = 3 THEN 3 WHEN s.qc_step_quality_flag = 1 THEN r.qc_range_quality_flag
    WHEN r.qc_range_quality_flag = 1 THEN s.qc_step_quality_flag ELSE 4 END AS flag2
  FROM stest s JOIN rtest r USING (station_id, variable_id, datetime)"""
TESTS = dict(**RCTE, **SCTE, rtest=RTEST, sdiff=DIFF, stest=STEST, bothq=BOTH)
FLAGCOLS = "station_id, variable_id, datetime, measured"
register(
    "qc_range_test",
    lambda t: qc.qc_range_test(t.obs_regular(), t.range_thr(), t.station(), t.variable()).select(
        *NAMES, "qc_range_quality_flag", "qc_range_description"
    ),
    f"SELECT {FLAGCOLS}, qc_range_quality_flag, qc_range_description FROM rtest",
    **TESTS,
)
register(
    "qc_step_test",
    lambda t: qc.qc_step_test(t.obs_regular(), t.step_thr(), t.station(), t.variable()).select(
        *NAMES, "qc_step_quality_flag", "qc_step_description"
    ),
    f"SELECT {FLAGCOLS}, qc_step_quality_flag, qc_step_description FROM stest",
    **TESTS,
)


def both_tests(t):
    thresholds = qc.station_limits(t.station(), range=t.range_thr(), step=t.step_thr())
    return qc.qc_tests(t.obs_regular(), thresholds, t.variable())


register(
    "qc_combine_ingest",
    lambda t: both_tests(t)
    .withColumn("quality_flag", qc.ingest_flag())
    .select(*NAMES, "qc_range_quality_flag", "qc_step_quality_flag", "quality_flag"),
    f"SELECT {FLAGCOLS}, qc_range_quality_flag, qc_step_quality_flag, flag2 AS quality_flag FROM bothq",
    **TESTS,
)
register(
    "qc_ingest",
    lambda t: qc.qc_ingest(t.obs_regular(), t.range_thr(), t.step_thr(), t.station(), t.variable()).select(
        *NAMES,
        "quality_flag",
        "code",
        "qc_range_quality_flag",
        "qc_range_description",
        "qc_step_quality_flag",
        "qc_step_description",
    ),
    f"""SELECT {FLAGCOLS}, flag2 AS quality_flag, NULL AS code, qc_range_quality_flag, qc_range_description, qc_step_quality_flag, qc_step_description
      FROM bothq WHERE variable_id <> 5
    UNION ALL SELECT station_id, variable_id, datetime, CAST(-99.9 AS DOUBLE), quality_flag, code, NULL, NULL, NULL, NULL FROM obs_regular WHERE variable_id = 5""",
    **TESTS,
)
register(
    "modal_interval",
    lambda t: qc.modal_interval(t.obs_regular()),
    'SELECT station_id, variable_id, ivl AS "interval" FROM modal',
    **PCTE,
)
register(
    "persist_window",
    lambda t: qc.persist_window(qc.modal_interval(t.obs_regular()), t.station(), t.variable()),
    'SELECT station_id, variable_id, ivl AS "interval", wnd AS "window" FROM pk',
    **PCTE,
)


def persist_tested(t):
    return qc.qc_persist_test(t.obs_regular(), limits(t))


def final(t):
    return qc.qc_final(t.obs_regular(), t.range_thr(), t.step_thr(), t.persist_thr(), t.station(), t.variable())


PTEST = """SELECT o.*, l.wnd, l.persist_min, l.persist_description,
  (SELECT max(p.measured) - min(p.measured) FROM obs_regular p WHERE p.station_id = o.station_id AND p.variable_id = o.variable_id
     AND p.datetime BETWEEN o.datetime - to_seconds(l.wnd) AND o.datetime) AS persist_value
  FROM obs_regular o LEFT JOIN plim l ON l.station_id = o.station_id AND l.variable_id = o.variable_id"""
PFLAG = """SELECT *, CASE WHEN persist_min IS NULL THEN 1 WHEN persist_value >= persist_min THEN 4 ELSE 3 END AS pf,
  CASE WHEN persist_min IS NULL THEN 'Threshold not found' ELSE persist_description END AS pd FROM ptest"""
PSUS = """SELECT *, pf NOT IN (3, 2) AND has_bad AS updated, CASE WHEN pf NOT IN (3, 2) AND has_bad THEN 2 ELSE pf END AS pf2 FROM (
  SELECT o.*, EXISTS (SELECT 1 FROM pflag p WHERE p.station_id = o.station_id AND p.variable_id = o.variable_id AND p.pf = 3
    AND p.datetime BETWEEN o.datetime AND o.datetime + to_seconds(o.wnd)) AS has_bad FROM pflag o)"""
PTESTS = dict(**PCTE, ptest=PTEST, pflag=PFLAG, psus=PSUS)
register(
    "qc_persist_test",
    lambda t: persist_tested(t).select(
        *NAMES, "window", "persist_value", "qc_persist_quality_flag", "qc_persist_description"
    ),
    f"""SELECT {FLAGCOLS}, wnd AS "window", persist_value, pf AS qc_persist_quality_flag, pd AS qc_persist_description FROM pflag""",
    **PTESTS,
)
register(
    "qc_persist_suspicious",
    lambda t: qc.qc_persist_suspicious(persist_tested(t)).select(*NAMES, "qc_persist_quality_flag", "updated"),
    f"SELECT {FLAGCOLS}, pf2 AS qc_persist_quality_flag, updated FROM psus",
    **PTESTS,
)
register(
    "qc_final_flag",
    lambda t: final(t).select(*NAMES, "qc_persist_quality_flag", "qc_range_quality_flag", "qc_step_quality_flag", "quality_flag"),
    f"""SELECT b.station_id, b.variable_id, b.datetime, b.measured, pf2 AS qc_persist_quality_flag, qc_range_quality_flag, qc_step_quality_flag,
      CASE WHEN 3 IN (pf2, qc_range_quality_flag, qc_step_quality_flag) THEN 3 WHEN 4 IN (pf2, qc_range_quality_flag, qc_step_quality_flag) THEN 4
        WHEN 2 IN (pf2, qc_range_quality_flag, qc_step_quality_flag) THEN 2 ELSE 1 END AS quality_flag
    FROM bothq b JOIN psus p USING (station_id, variable_id, datetime)""",
    **TESTS,
    **PTESTS,
)

# Late readings: a day's worth of every series, and a second stretch of some.
LATE = "hour(datetime) = 7 AND day(datetime) BETWEEN 27 AND 29 OR station_id % 3 = 0 AND datetime BETWEEN TIMESTAMP '2024-01-31 10:00:00' AND TIMESTAMP '2024-01-31 15:00:00'"


def refreshed(t):
    """Readings stored with the flags they had without the late ones; the late ones; the limits."""
    thresholds = stored(limits(t), "persist-limits")
    ranged = both_tests(t)
    early = qc.qc_persist_suspicious(qc.qc_persist_test(t.obs_regular().filter(f"NOT ({LATE})"), thresholds))
    old = early.select(*KEY, *qc.PERSIST_RESULT)
    obs = ranged.join(old, KEY, "left").withColumn("quality_flag", qc.final_flag())
    return stored(obs, "flagged"), obs.filter(LATE), thresholds


def hours_refreshed(t):
    obs, late, thresholds = refreshed(t)
    before = summary.hourly_summary(obs.filter(f"NOT ({LATE})"))
    return refresh.refresh_hours(obs, late, thresholds, before)[1]


PSUB = {
    "obs_sub": f"SELECT * FROM obs_regular WHERE NOT ({LATE})",
    "ptest_sub": PTEST.replace("obs_regular", "obs_sub"),
    "pflag_sub": PFLAG.replace("ptest", "ptest_sub"),
    "psus_sub": PSUS.replace("pflag", "pflag_sub"),
}
FINAL = """CASE WHEN 3 IN (pf2, qc_range_quality_flag, qc_step_quality_flag) THEN 3 WHEN 4 IN (pf2, qc_range_quality_flag, qc_step_quality_flag) THEN 4
        WHEN 2 IN (pf2, qc_range_quality_flag, qc_step_quality_flag) THEN 2 ELSE 1 END"""
CHANGED = f"""SELECT b.station_id, b.variable_id, b.datetime, b.is_daily, p.pf2 AS qc_persist_quality_flag, p.pd AS qc_persist_description, {FINAL} AS quality_flag
    FROM bothq b JOIN psus p USING (station_id, variable_id, datetime) LEFT JOIN (SELECT station_id, variable_id, datetime, pf2 AS old FROM psus_sub) s
      USING (station_id, variable_id, datetime) WHERE s.old IS DISTINCT FROM p.pf2"""
REFRESH = dict(**TESTS, **PTESTS, **PSUB, pchanged=CHANGED)
register(
    "qc_persist_refresh",
    lambda t: qc.qc_persist_refresh(*refreshed(t)).select(*KEY, *qc.PERSIST_RESULT, "quality_flag"),
    "SELECT * EXCLUDE (is_daily) FROM pchanged",
    **REFRESH,
)


def stale(t):
    obs, late, thresholds = refreshed(t)
    return refresh.stale_hours(late, qc.qc_persist_refresh(obs, late, thresholds))


register(
    "qc_persist_stale_hours",
    stale,
    """SELECT DISTINCT station_id, CASE WHEN NOT is_daily AND datetime = date_trunc('day', datetime) THEN date_trunc('hour', datetime - INTERVAL 1 SECOND)
      ELSE date_trunc('hour', datetime) END AS datetime, is_daily FROM pchanged""",
    **REFRESH,
)
register(
    "recompute_after_persistence",
    hours_refreshed,
    f"""SELECT CASE WHEN NOT is_daily AND datetime = date_trunc('day', datetime) THEN date_trunc('hour', datetime - INTERVAL 1 SECOND)
      ELSE date_trunc('hour', datetime) END AS datetime, station_id, variable_id, is_daily, {AGG} FROM pfinal WHERE {VALID} GROUP BY 1, 2, 3, 4""",
    pfinal=f"""SELECT b.* EXCLUDE (quality_flag), coalesce(consisted, b.measured) AS v, {FINAL} AS quality_flag
      FROM bothq b JOIN (SELECT station_id, variable_id, datetime, pf2 FROM psus) p USING (station_id, variable_id, datetime)""",
    **REFRESH,
)

TXT = "coalesce(CAST({0} AS VARCHAR), '---')"


def matrix_sql(thr: str, more: str, limits: dict, months: bool) -> str:
    cols = []
    for label, (limit, overall) in limits.items():
        cols += [
            f"{TXT.format(overall)} AS global_{label}",
            f"CASE WHEN c.station_id IS NOT NULL THEN {TXT.format(f'c.{limit}')} ELSE coalesce(CAST(d.{limit} AS VARCHAR) || '*', '---') END AS reference_{label}",
            f"{TXT.format(f'a.{limit}')} AS custom_{label}",
        ]
    grid = "SELECT sv.*, CAST(m AS INT) AS month FROM sv, range(1, 13) r(m)" if months else "SELECT * FROM sv"
    month = "k.month," if months else ""
    join = "LEFT JOIN {thr} {a} ON {a}.station_id = {o} AND {a}.variable_id = k.variable_id AND {iv} {more}"
    joins = " ".join(
        join.format(thr=thr, a=a, o=o, iv=iv, more=more.format(a=a))
        for a, o, iv in (
            ("a", "k.station_id", "a.ivl = 3600"),
            ("c", "k.reference_station_id", "c.ivl = 3600"),
            ("d", "k.reference_station_id", "d.ivl IS NULL"),
        )
    )
    return f"""SELECT k.station_id, k.variable_id, {month} {', '.join(cols)} FROM (
      SELECT g.*, s.is_automatic, s.reference_station_id, v.* EXCLUDE (id), {WINDOW} AS wnd FROM ({grid}) g
        JOIN station s ON s.id = g.station_id JOIN variable v ON v.id = g.variable_id) k {joins}"""


register(
    "threshold_matrix",
    lambda t: qc.threshold_matrix(t.station_variable(), t.range_thr(), t.station(), t.variable(), 3600),
    matrix_sql(
        "range_thr",
        "AND {a}.month = k.month",
        {
            "min": ("range_min", "CASE WHEN k.is_automatic THEN k.range_min_hourly ELSE k.range_min END"),
            "max": ("range_max", "CASE WHEN k.is_automatic THEN k.range_max_hourly ELSE k.range_max END"),
        },
        True,
    ),
)
STEP_SIZE = "CASE WHEN k.is_automatic THEN k.step_hourly ELSE k.step END"
register(
    "step_threshold_matrix",
    lambda t: qc.step_threshold_matrix(t.station_variable(), t.step_thr(), t.station(), t.variable(), 3600),
    matrix_sql("step_thr", "", {"min": ("step_min", f"-({STEP_SIZE})"), "max": ("step_max", STEP_SIZE)}, False),
)
register(
    "persist_threshold_matrix",
    lambda t: qc.persist_threshold_matrix(t.station_variable(), t.persist_thr(), t.station(), t.variable(), 3600),
    matrix_sql(
        "persist_thr",
        "AND {a}.wnd = k.wnd",
        {
            "var": ("minimum_variance", "CASE WHEN k.is_automatic THEN k.persistence_hourly ELSE k.persistence END"),
            "win": ("wnd", "k.wnd"),
        },
        False,
    ),
)
register(
    "range_threshold_list",
    lambda t: qc.range_threshold_list(t.range_thr(), t.variable()),
    """SELECT station_id, variable_id, ivl AS "interval", t.month, t.range_min, t.range_max, v.symbol, v.name AS variable_name,
      strftime(make_date(2000, t.month, 1), '%B') AS month_name FROM range_thr t JOIN variable v ON v.id = variable_id""",
)
register(
    "qc_review_list",
    lambda t: qc.qc_review_list(t.obs()),
    """SELECT station_id, variable_id, datetime, measured, consisted, quality_flag AS automatic_flag, manual_flag, remarks, ml_flag FROM obs""",
)
