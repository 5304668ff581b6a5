"""colophon: bibliographic entity resolution and discovery as PySpark DataFrame operators."""

__version__ = "0.1.0"
