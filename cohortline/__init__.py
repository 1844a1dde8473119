"""Filter-driven time-series analytics over yearly microdata, declared on Spark DataFrames."""
