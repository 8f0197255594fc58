"""Layered language identification and corpus analytics over Spark DataFrames."""
