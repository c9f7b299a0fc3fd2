"""Operators over frames: DataFrame in, DataFrame out."""
