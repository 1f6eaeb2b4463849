"""Tideline: vintage-safe panel analytics on Spark DataFrames."""
