"""factgraph: fact and provenance graph analytics as functions from DataFrames to DataFrames."""
