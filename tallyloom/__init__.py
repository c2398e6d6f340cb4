"""tallyloom - usage analytics for coding-agent session logs, as Spark jobs."""

__version__ = "0.1.0"
