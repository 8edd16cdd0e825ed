"""Find, judge and protect sensitive content in large text collections, on Spark DataFrames."""
