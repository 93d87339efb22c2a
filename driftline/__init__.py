"""driftline: model-drift analytics as Spark DataFrame, SQL, MLlib and streaming jobs."""

from driftline.config import DriftConfig

__all__ = ["DriftConfig"]
