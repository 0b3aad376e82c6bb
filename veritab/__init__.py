"""A PySpark-native engine for building and scoring robustness benchmarks for vision-language models."""
