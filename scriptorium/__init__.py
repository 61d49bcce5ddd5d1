"""Scriptorium: document analytics on Spark DataFrames."""
