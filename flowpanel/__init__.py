"""Audited fund-by-period panels and their econometrics on Spark DataFrames."""
