"""Row layouts of the observation model."""

from pyspark.sql import types as T

OBS = T.StructType(
    [
        T.StructField("station_id", T.IntegerType(), False),
        T.StructField("variable_id", T.IntegerType(), False),
        T.StructField("datetime", T.TimestampType(), False),
        T.StructField("measured", T.DoubleType()),
        T.StructField("consisted", T.DoubleType()),
        T.StructField("quality_flag", T.IntegerType()),
        T.StructField("manual_flag", T.IntegerType()),
        T.StructField("is_daily", T.BooleanType(), False),
        T.StructField("remarks", T.StringType()),
        T.StructField("observer", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("ml_flag", T.IntegerType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# Layouts of the given tables; stated, so that no query starts with a job that infers them.
SOURCES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

KEY = ["station_id", "variable_id", "datetime"]
SERIES = ["station_id", "variable_id"]
SUMMARY_VALUES = ["min_value", "max_value", "avg_value", "sum_value", "num_records"]

# Quality flags.
FLAGS = [
    (1, "-", "Not checked", "#FFFFFF"),
    (2, "S", "Suspicious", "#e8d43f"),
    (3, "B", "Bad", "#f73e25"),
    (4, "G", "Good", "#3bd424"),
]

# Sampling operations.
SAMPLING = [
    (1, "INST"),
    (2, "AVG"),
    (3, "MIN"),
    (4, "MAX"),
    (5, "STDV"),
    (6, "ACCUM"),
    (7, "Counter"),
    (8, "RMS"),
    (9, "Variation"),
]
