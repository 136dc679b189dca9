"""Operators: DataFrame to DataFrame, without collecting and without Python in the hot path."""
