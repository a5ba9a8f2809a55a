"""Operators over tables of runs: each takes DataFrames keyed by run_id and returns DataFrames."""
