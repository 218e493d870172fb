"""Equipment and maintenance, on visits made of orders and their lines."""

import datetime as dt

from pyspark.sql import functions as F

from checks.registry import register
from pluvio.operators import equipment as eq


def visits(t):
    """One visit per station and day."""
    o = F.col("id")
    return (
        t.raw("orders")
        .groupBy(
            F.floor(F.col("o_custkey") / 15).cast("int").alias("station_id"),
            F.to_date("o_orderdate").alias("visit_date"),
        )
        .agg(F.min("o_orderkey").alias("id"))
        .select(
            "id",
            "station_id",
            "visit_date",
            F.when(o % 11 == 0, "-").when(o % 3 == 0, "A").when(o % 3 == 1, "P").otherwise("D").alias("status"),
            (o % 25).cast("int").alias("technician_id"),
            (o % 5).cast("int").alias("visit_type_id"),
            F.when(o % 4 == 0, "").otherwise(F.concat(F.lit("contact "), o.cast("string"))).alias("contacts"),
        )
    )


VISITS = """SELECT id, station_id, visit_date, CASE WHEN id % 11 = 0 THEN '-' WHEN id % 3 = 0 THEN 'A' WHEN id % 3 = 1 THEN 'P' ELSE 'D' END AS status,
  CAST(id % 25 AS INT) AS technician_id, CAST(id % 5 AS INT) AS visit_type_id, CASE WHEN id % 4 = 0 THEN '' ELSE 'contact ' || id END AS contacts
  FROM (SELECT CAST(o_custkey // 15 AS INT) AS station_id, CAST(o_orderdate AS DATE) AS visit_date, min(o_orderkey) AS id FROM orders GROUP BY 1, 2)"""


def visit_equipment(t):
    kind, part = F.col("l_returnflag"), F.col("l_partkey")
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("visit_id"),
        F.col("l_linenumber").alias("equipment_order"),
        F.when(kind != "A", part).alias("old_equipment_id"),
        F.when(kind == "A", part)
        .when(kind == "N", F.when(F.col("l_linenumber") % 2 == 0, part).otherwise(part + 1))
        .alias("new_equipment_id"),
    )


VE = """SELECT l_orderkey AS visit_id, l_linenumber AS equipment_order, CASE WHEN l_returnflag <> 'A' THEN l_partkey END AS old_equipment_id,
  CASE WHEN l_returnflag = 'A' THEN l_partkey WHEN l_returnflag = 'N' THEN CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_partkey + 1 END END AS new_equipment_id
  FROM lineitem"""
CHANGE = """CASE WHEN old_equipment_id IS NULL THEN 'Add' WHEN new_equipment_id IS NULL THEN 'Remove' WHEN old_equipment_id <> new_equipment_id THEN 'Change' ELSE 'Update' END"""


def side_sql(side: str) -> str:
    return f"""SELECT {side}_equipment_id AS equipment_id, v.visit_date, v.station_id, v.status FROM ve JOIN visits v ON v.id = visit_id
      WHERE {side}_equipment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {side}_equipment_id ORDER BY visit_date DESC, visit_id DESC) = 1"""


STATUS = """SELECT coalesce(n.equipment_id, o.equipment_id) AS equipment_id, n.station_id AS new_station, o.station_id AS old_station, o.status AS old_status,
  o.equipment_id IS NOT NULL AS has_old, n.equipment_id IS NOT NULL AND (o.equipment_id IS NULL OR n.visit_date >= o.visit_date) AS installed
  FROM newest n FULL JOIN oldest o ON n.equipment_id = o.equipment_id"""
LOCATION = """SELECT q.equipment_id, CASE WHEN installed THEN new_station END AS location_id, CASE WHEN installed THEN coalesce(s.name || ' - ' || s.code, 'Office') ELSE 'Office' END AS location
  FROM status q LEFT JOIN station s ON s.id = q.new_station"""
C = dict(visits=VISITS, ve=VE, newest=side_sql("new"), oldest=side_sql("old"), status=STATUS, location=LOCATION)


def equipment(t):
    p = F.col("p_partkey")
    return t.raw("part").select(
        p.alias("id"),
        (F.col("p_size") % 6).alias("equipment_type_id"),
        (p % 26).cast("int").alias("manufacturer_id"),
        (p % 5).cast("int").alias("funding_source_id"),
        F.col("p_name").alias("model"),
        F.concat("p_brand", F.lit("-"), p.cast("string")).alias("serial_number"),
        F.when(p % 4 == 0, "F").when(p % 4 == 1, "P").when(p % 4 == 2, "N").alias("classification"),
    )


def regions(t):
    return t.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


def nations(t):
    return t.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def location(t):
    return eq.equipment_location(visit_equipment(t), visits(t), t.station())


register("equipment_location", location, "SELECT * FROM location", **C)
register(
    "equipment_available",
    lambda t: eq.equipment_available(equipment(t), visit_equipment(t), visits(t)),
    """SELECT p_partkey AS equipment_id, CASE WHEN has_old AND old_status <> 'A' THEN old_station END AS only_station_id
    FROM part LEFT JOIN status ON equipment_id = p_partkey WHERE NOT coalesce(installed, false)""",
    **C,
)
register(
    "equipment_inventory",
    lambda t: eq.equipment_inventory(equipment(t), regions(t), nations(t), regions(t), location(t)),
    """SELECT p_partkey AS equipment_id, a.r_name AS equipment_type, n_name AS manufacturer, b.r_name AS funding_source, p_name AS model,
      p_brand || '-' || p_partkey AS serial_number, coalesce(l.location, 'Office') AS location, l.location_id,
      CASE p_partkey % 4 WHEN 0 THEN 'Fully Functional' WHEN 1 THEN 'Partially Functional' WHEN 2 THEN 'Not Functional' END AS classification, p_size % 6 AS equipment_type_id
    FROM part JOIN region a ON a.r_regionkey = p_size % 6 JOIN nation ON n_nationkey = p_partkey % 26 JOIN region b ON b.r_regionkey = p_partkey % 5
      LEFT JOIN location l ON l.equipment_id = p_partkey""",
    **C,
)
register(
    "maintenance_list",
    lambda t: eq.maintenance_list(
        visits(t), t.station(), regions(t), nations(t), regions(t), dt.date(1996, 1, 1), dt.date(2000, 12, 31), True
    ),
    """SELECT v.id AS visit_id, s.name AS station_name, p.r_name AS station_profile, 'Automatic' AS station_type, visit_date, n_name AS technician,
      y.r_name AS type_of_visit, CASE status WHEN 'A' THEN 'Approved' WHEN 'P' THEN 'Published' ELSE 'Draft' END AS status
    FROM visits v JOIN station s ON s.id = v.station_id JOIN region p ON p.r_regionkey = s.profile_id JOIN nation ON n_nationkey = technician_id
      JOIN region y ON y.r_regionkey = visit_type_id
    WHERE visit_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND status <> '-' AND is_automatic""",
    visits=VISITS,
)
register(
    "equipment_transitions",
    lambda t: eq.equipment_transitions(visit_equipment(t)),
    f"SELECT *, {CHANGE} AS change FROM ve",
    ve=VE,
)
register(
    "previous_visit_equipment",
    lambda t: eq.previous_visit_equipment(visits(t), visit_equipment(t)),
    f"""SELECT v.id AS visit_id, v.station_id, prev AS previous_visit_id, equipment_order, new_equipment_id AS old_equipment_id, new_equipment_id, {CHANGE} AS change
    FROM (SELECT *, lag(id) OVER (PARTITION BY station_id ORDER BY visit_date) AS prev FROM visits) v JOIN ve ON ve.visit_id = prev
    WHERE new_equipment_id IS NOT NULL""",
    **C,
)
register(
    "first_contacts",
    lambda t: eq.first_contacts(visits(t)),
    "SELECT station_id, arg_min(contacts, visit_date) AS contacts FROM visits WHERE contacts <> '' GROUP BY 1",
    visits=VISITS,
)


def history(t):
    at = F.timestamp_seconds(
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") % 86400
    )
    return (
        t.raw("lineitem")
        .groupBy(F.col("l_partkey").alias("equipment_id"), at.alias("datetime"))
        .agg(
            F.nullif(F.min("l_returnflag"), F.lit("N")).alias("condition"),
            F.min("l_linestatus").alias("class"),
            F.min("l_linenumber").alias("slot"),
        )
    )


HISTORY = """SELECT l_partkey AS equipment_id, l_shipdate + to_seconds(l_orderkey % 86400) AS datetime, nullif(min(l_returnflag), 'N') AS condition,
  min(l_linestatus) AS class, min(l_linenumber) AS slot FROM lineitem GROUP BY 1, 2"""
register(
    "equipment_change_history",
    lambda t: eq.equipment_change_history(history(t), ["condition", "class", "slot"]),
    """SELECT equipment_id, datetime, u.field, u.o AS old_value, u.n AS new_value FROM (
      SELECT equipment_id, datetime, row_number() OVER w AS version, unnest([{'field': 'condition', 'o': lag(condition) OVER w, 'n': condition},
        {'field': 'class', 'o': lag(class) OVER w, 'n': class}, {'field': 'slot', 'o': CAST(lag(slot) OVER w AS VARCHAR), 'n': CAST(slot AS VARCHAR)}]) AS u
      FROM history WINDOW w AS (PARTITION BY equipment_id ORDER BY datetime)) WHERE version > 1 AND u.o IS DISTINCT FROM u.n""",
    history=HISTORY,
)
