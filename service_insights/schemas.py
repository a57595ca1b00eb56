"""Explicit StructTypes for every table the library reads or writes."""
from __future__ import annotations

from pyspark.sql import types as T

SERVICE = T.StructType([
    T.StructField("service_id", T.LongType()),
    T.StructField("vehicle_id", T.LongType()),
    T.StructField("technician_id", T.IntegerType()),
    T.StructField("service_date", T.DateType()),
    T.StructField("service_type", T.StringType()),
    T.StructField("service_performed", T.StringType()),
    T.StructField("flagged_components", T.ArrayType(T.StringType())),
    T.StructField("ground_truth", T.StringType()),
])

CUSTOMER = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("address", T.StringType()),
])

VEHICLE = T.StructType([
    T.StructField("vehicle_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("make", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("vin", T.StringType()),
])

TECHNICIAN = T.StructType([
    T.StructField("technician_id", T.IntegerType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("specialization", T.StringType()),
])

COMPONENTS = T.StructType([
    T.StructField("component_key", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("rubric", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("sort_order", T.IntegerType()),
])

CONFIGS = T.StructType([
    T.StructField("config_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("model_endpoint", T.StringType()),
    T.StructField("components", T.StringType()),
    T.StructField("prompt_text", T.StringType()),
    T.StructField("response_format", T.StringType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("config_id", T.StringType()),
    T.StructField("config_name", T.StringType()),
    T.StructField("model_endpoint", T.StringType()),
    T.StructField("source_table", T.StringType()),
    T.StructField("row_count", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
])

RUN_RESULTS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("service_id", T.LongType()),
    T.StructField("component_key", T.StringType()),
    T.StructField("classification", T.StringType()),
    T.StructField("reasoning", T.StringType()),
])

ASSESSMENT = T.StructType([
    T.StructField("component", T.StringType()),
    T.StructField("classification", T.StringType()),
    T.StructField("reasoning", T.StringType()),
])

# Shape of a parsed scoring answer.
RESPONSE = T.StructType([
    T.StructField("assessments", T.ArrayType(ASSESSMENT)),
])

# Component list stored as JSON text inside a config row.
CONFIG_COMPONENT = T.StructType([
    T.StructField("component_key", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("rubric", T.StringType()),
])
CONFIG_COMPONENTS = T.ArrayType(CONFIG_COMPONENT)

RECOMMENDATIONS = T.StructType([
    T.StructField("service_id", T.LongType()),
    T.StructField("vehicle_id", T.LongType()),
    T.StructField("service_performed", T.StringType()),
    T.StructField("component_key", T.StringType()),
    T.StructField("classification", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("technician_flagged", T.BooleanType()),
])
