"""Customer-journey process mining and shop-funnel analytics as Spark DataFrames."""

from cartrail.spec import EventLog, LogSpec

__all__ = ["EventLog", "LogSpec"]
