"""Token, cost and capability estimates for text and media corpora on Spark DataFrames."""
