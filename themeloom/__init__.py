"""Topic analytics for large text tables, written as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame keyed by document or
topic.  See README.md for the layout.
"""
