"""emberlake: security analytics and corpus preparation on Spark DataFrames."""
