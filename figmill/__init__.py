"""figmill: a Spark-native engine for figure and table evidence.

Every operator takes DataFrames and returns a lazy DataFrame; the per-figure
loops of a scripted pipeline become partitioning keys.
"""
