"""Property-graph analytics on PySpark: a nodes table, an edges table and an ontology, as DataFrames."""
