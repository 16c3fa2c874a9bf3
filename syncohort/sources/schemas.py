"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

REGISTRY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("diag_date", T.DateType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("sex", T.IntegerType()),
        T.StructField("stage", T.IntegerType()),
        T.StructField("vital", T.StringType()),
        T.StructField("vital_date", T.DateType()),
    ]
)

#: One row per person, dates as text such as 31dec2021.
COHORT_CSV = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("sex", T.IntegerType()),
        T.StructField("stage", T.IntegerType()),
        T.StructField("daar_grp", T.IntegerType()),
        T.StructField("diag_date", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("exit", T.StringType()),
        T.StructField("t", T.DoubleType()),
    ]
)

HOLDOUT_CSV = T.StructType([*COHORT_CSV.fields, T.StructField("holdout", T.IntegerType())])

RUN_FIELDS = [
    T.StructField("site", T.StringType()),
    T.StructField("model", T.IntegerType()),
    T.StructField("sim", T.IntegerType()),
]

