"""Speech-segment, subtitle and job-state operators on Spark DataFrames."""
