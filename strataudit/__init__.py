"""Attestation analytics as Spark jobs.

Four tables (applications, data stores, data objects, object fields) are joined and nested into one
document per application, kept as a versioned snapshot, looked up, counted, reviewed and checked.
Every operator takes DataFrames and returns a DataFrame.
"""
