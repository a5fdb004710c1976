"""Declared schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

METRICS = ["usage_cpu", "usage_storage", "users_active"]
FACTORS = ["economic_index", "cloud_market_demand"]
NUMERIC = METRICS + FACTORS
RESOURCES = ["VM", "Storage", "Container"]
METRIC_TYPES = {"cpu": "usage_cpu", "users": "users_active", "storage": "usage_storage"}
MODEL_TYPES = ["SeasonalNaive", "Naive", "WeeklyMean"]

USAGE = (
    T.StructType()
    .add("date", "date")
    .add("region", "string")
    .add("resource_type", "string")
    .add("usage_cpu", "double")
    .add("usage_storage", "double")
    .add("users_active", "integer")
    .add("economic_index", "double")
    .add("cloud_market_demand", "double")
    .add("holiday", "integer")
)
EXTERNAL = (
    T.StructType()
    .add("date", "date")
    .add("economic_index", "double")
    .add("cloud_market_demand", "double")
    .add("holiday", "integer")
)
MODEL_PERFORMANCE = (
    T.StructType()
    .add("region", "string")
    .add("metric_type", "string")
    .add("model_type", "string")
    .add("rmse", "double")
    .add("mae", "double")
    .add("mape", "double")
    .add("training_date", "date")
    .add("data_hash", "string")
    .add("data_size", "long")
    .add("is_active", "boolean")
)
DATA_MONITORING = (
    T.StructType()
    .add("check_date", "date")
    .add("data_hash", "string")
    .add("data_size", "long")
    .add("new_records", "long")
    .add("training_triggered", "boolean")
)
BEST_MODEL = (
    T.StructType()
    .add("region", "string")
    .add("metric_type", "string")
    .add("model_type", "string")
    .add("rmse", "double")
    .add("mae", "double")
    .add("mape", "double")
    .add("updated_date", "date")
)
PREDICTION_ACCURACY = (
    T.StructType()
    .add("region", "string")
    .add("model_type", "string")
    .add("metric_type", "string")
    .add("prediction_date", "date")
    .add("predicted_value", "double")
    .add("actual_value", "double")
    .add("absolute_error", "double")
    .add("percentage_error", "double")
)
REGISTRY = {
    "model_performance": MODEL_PERFORMANCE,
    "data_monitoring": DATA_MONITORING,
    "best_model": BEST_MODEL,
    "prediction_accuracy": PREDICTION_ACCURACY,
}
