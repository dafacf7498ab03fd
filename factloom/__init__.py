"""factloom: relational code-intelligence analytics expressed as Spark DataFrames."""
