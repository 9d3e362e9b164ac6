"""strataform: a batch analytics library on the PySpark DataFrame API."""

__version__ = "0.1.0"
