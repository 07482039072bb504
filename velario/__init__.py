"""velario: document de-identification and text preparation on Spark DataFrames."""
