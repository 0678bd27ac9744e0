"""Path-query operators on DataFrames."""
