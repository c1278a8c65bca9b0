"""Continuous-integration test history as Spark DataFrames."""
