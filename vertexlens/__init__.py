"""Approximate graph analytics on DataFrames, and operators for training-data pipelines."""
