"""Schemas of the tables that enter and leave the library."""

from pyspark.sql import types as T

FACTS = T.StructType([
    T.StructField("Store", T.IntegerType()),
    T.StructField("DayOfWeek", T.IntegerType()),
    T.StructField("Date", T.DateType()),
    T.StructField("Sales", T.LongType()),
    T.StructField("Customers", T.LongType()),
    T.StructField("Open", T.IntegerType()),
    T.StructField("Promo", T.IntegerType()),
    T.StructField("StateHoliday", T.StringType()),
    T.StructField("SchoolHoliday", T.IntegerType()),
])

STORES = T.StructType([
    T.StructField("Store", T.IntegerType()),
    T.StructField("StoreType", T.StringType()),
    T.StructField("Assortment", T.StringType()),
    T.StructField("CompetitionDistance", T.DoubleType()),
    T.StructField("CompetitionOpenSinceMonth", T.IntegerType()),
    T.StructField("CompetitionOpenSinceYear", T.IntegerType()),
    T.StructField("Promo2", T.IntegerType()),
    T.StructField("Promo2SinceWeek", T.IntegerType()),
    T.StructField("Promo2SinceYear", T.IntegerType()),
    T.StructField("PromoInterval", T.StringType()),
])

FUTURE = T.StructType([
    T.StructField("Id", T.LongType()),
    T.StructField("Store", T.IntegerType()),
    T.StructField("DayOfWeek", T.IntegerType()),
    T.StructField("Date", T.DateType()),
    T.StructField("Open", T.IntegerType()),
    T.StructField("Promo", T.IntegerType()),
    T.StructField("StateHoliday", T.StringType()),
    T.StructField("SchoolHoliday", T.IntegerType()),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("store_id", T.IntegerType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
])

RUNS = T.StructType([
    T.StructField("run_uuid", T.StringType()),
    T.StructField("name", T.StringType()),
])

RUN_METRICS = T.StructType([
    T.StructField("run_uuid", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

RUN_TEXT = T.StructType([
    T.StructField("run_uuid", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

RUN_FEATURES = T.StructType([
    T.StructField("run_uuid", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("feature", T.StringType()),
    T.StructField("gain", T.DoubleType()),
])

VOCABULARY = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("number", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("code", T.LongType()),
])
