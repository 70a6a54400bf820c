"""sqlkiln: text-to-SQL corpus preparation, batch inference and confidence
scoring as Spark DataFrame jobs."""

__version__ = "0.1.0"
