"""strandflow: sequencing-read preprocessing, quality control and text-corpus operators on Spark DataFrames."""
