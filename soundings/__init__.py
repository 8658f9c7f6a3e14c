"""Quality control of vertical profiles, and other table work, on Spark DataFrames."""
