"""Touchline: match analytics expressed as Spark DataFrame jobs.

Every public operator takes DataFrames and returns a DataFrame.  Nothing in
the package collects rows to the driver and nothing uses a Python UDF.
"""
