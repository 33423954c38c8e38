"""Cohort selection, index times, observation-window features and model comparison on Spark DataFrames."""
