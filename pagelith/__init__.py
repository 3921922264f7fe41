"""pagelith: document-alignment and corpus analytics on Spark DataFrames."""
