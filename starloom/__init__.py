"""Time-series reconstruction of sky catalogues as Spark jobs."""

__version__ = "0.1.0"
