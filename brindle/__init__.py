"""Event analytics on Spark: schema-light ingest, a small declarative query spec, maintained aggregates."""

__version__ = "0.1.0"
