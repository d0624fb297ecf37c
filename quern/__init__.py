"""quern: a PySpark-native engine that mills a document corpus into a queryable knowledge base."""

__version__ = "0.1.0"
