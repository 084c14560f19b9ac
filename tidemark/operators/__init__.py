"""Relational operators: DataFrame in, DataFrame out, physical planning left to Spark."""
