"""Candidate triage on Spark: evidence tables in, gates, funnel and reports out.

Every function takes DataFrames and returns a DataFrame; nothing here collects
candidate rows to the driver.
"""
