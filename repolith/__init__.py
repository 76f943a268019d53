"""repolith: repository analytics expressed as Spark DataFrame pipelines."""

__all__ = ["runtime"]
