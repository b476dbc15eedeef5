"""tessera: a PySpark-native engine for regulatory change analysis, query APIs and text corpora."""
