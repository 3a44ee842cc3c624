"""tessera: a DataFrame-first analytics library for Spark."""

__version__ = "0.1.0"
