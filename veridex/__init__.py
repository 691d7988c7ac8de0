"""veridex: a PySpark-native engine for evidence data, decisions and training-data preparation."""
