"""riskgrid: similarity-based transaction risk scoring on Spark DataFrames."""
