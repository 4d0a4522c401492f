"""Table operators: plain functions from DataFrame to DataFrame."""
