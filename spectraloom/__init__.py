"""spectraloom: tandem-mass-spectrum database search on Spark DataFrames."""
