"""folioscope: a PySpark-native engine for dated, multi-author document collections."""

__version__ = "0.1.0"
