"""quarry: a PySpark-native analytics engine for compiled mobile application packages."""

__version__ = "0.1.0"
