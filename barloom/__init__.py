"""Daily-bar analytics and corpus preparation on Spark DataFrames."""
