"""Spark-first consistency analytics over multi-sensor residual streams."""
