"""millrace: a PySpark-native engine for language-model training corpora."""

__version__ = "0.1.0"
