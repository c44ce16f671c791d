"""Every registered query of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import feature_queries, fit_queries, forecast_queries, model_queries, models, online_queries, panel_queries, prices, risk, score_queries, smooth_queries, store_queries, walk_queries
from gridloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "feature_queries", "fit_queries", "flagship", "forecast_queries", "model_queries", "models", "online_queries", "panel_queries", "prices", "risk", "score_queries", "smooth_queries", "store_queries", "walk_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layered forecast of each hour."""
    return QUERIES["layered_forecast"](spark, sf_dir)
