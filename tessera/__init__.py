"""Numerical and corpus analytics as Spark dataflow."""
