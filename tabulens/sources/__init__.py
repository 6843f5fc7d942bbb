"""Reading files into DataFrames and writing results."""
