"""busweave: regionalising aggregate data to network nodes on Spark DataFrames."""
