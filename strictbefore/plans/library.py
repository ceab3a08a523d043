"""All registered queries: importing this module runs the modules that register them."""

from strictbefore.plans import feature_queries, landed_queries, live_queries, model_queries, pipeline_queries, prediction_queries, record_queries, scalar_queries, sql_queries, stored_queries, stream_queries, waterfall_queries
from strictbefore.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "feature_queries", "landed_queries", "live_queries", "model_queries", "pipeline_queries", "prediction_queries", "record_queries", "scalar_queries", "sql_queries", "stored_queries", "stream_queries", "waterfall_queries"]
