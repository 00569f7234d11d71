"""Condition-monitoring and evidence-retrieval analytics on PySpark DataFrames."""
