"""Record linkage and text curation on Spark DataFrames."""
