"""Districting analytics on Spark: precinct ETL, contiguity graphs, plans and their scores."""
