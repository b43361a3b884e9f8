"""PySpark-native engine for routing and compute-budget analysis of per-question outcomes."""
