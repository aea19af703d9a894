"""Table operators: every one maps DataFrames to a DataFrame without running a job, unless it says so."""
