"""leafmill: catalog curation and document processing on Spark DataFrames."""
