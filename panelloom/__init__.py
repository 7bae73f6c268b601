"""Panel analytics on Spark: clean, describe, score and forecast many daily series at once."""

from panelloom.session import checkpointed, get_spark

__all__ = ["checkpointed", "get_spark"]
