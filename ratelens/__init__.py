"""ratelens: auditing group bias in generated text on Spark DataFrames."""
