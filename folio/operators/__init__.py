"""Operators over tables of documents: DataFrames in, DataFrames out."""
