"""Column-level building blocks: functions that return a Spark ``Column``."""
