"""broadsheet: analysis and search over large collections of news-like text, on Spark DataFrames."""
