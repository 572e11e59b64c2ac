"""Operators of the quote engine: DataFrame in, DataFrame out."""
