"""Laboratory measurements, an identification catalog and protocol texts as Spark tables."""

__version__ = "0.1.0"
