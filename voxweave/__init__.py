"""voxweave: timed-transcript analytics on Spark DataFrames."""
