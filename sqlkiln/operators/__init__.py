"""Distributed operators: DataFrame -> DataFrame."""
