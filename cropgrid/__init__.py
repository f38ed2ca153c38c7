"""cropgrid: crop viability analytics by municipality as Spark DataFrame plans."""

__version__ = "0.1.0"
