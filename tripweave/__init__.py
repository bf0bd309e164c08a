"""Human-mobility analytics as Spark DataFrame transformations.

Every operator takes DataFrames and returns a lazy DataFrame built from Spark
expressions, joins, aggregates and windows.
"""
