"""graphloom: property-graph ETL and analytics on Spark DataFrames."""
