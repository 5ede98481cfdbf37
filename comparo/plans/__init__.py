"""Report pipelines (what a user calls). Each returns lazy DataFrames."""
