"""lodepath: path questions over large directed concept graphs, as PySpark DataFrames."""
