"""Nucleus-level image analytics and corpus processing on Spark."""
