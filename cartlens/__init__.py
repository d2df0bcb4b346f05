"""Commerce analytics on Spark: cleaning, key checks, flat frames, metrics and chart tables."""

from cartlens.session import get_spark, tune

__all__ = ["get_spark", "tune"]
