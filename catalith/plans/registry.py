"""The named queries over the driver's tables, each with its SQL twin where one exists."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = ("catalog", "discovery", "documents", "evaluation", "records", "outcomes", "web", "reports", "schemas", "ruled", "recording", "delivery", "searches", "claims", "registries", "files", "manifests")


def _modules():
    return [importlib.import_module(f"catalith.plans.{m}") for m in MODULES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalith.plans.catalog import catalog_decisions

    return catalog_decisions(spark, sf_dir)


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLE_SQL.items()}
