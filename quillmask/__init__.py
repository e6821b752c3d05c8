"""Privacy-aware text and screen analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
