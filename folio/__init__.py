"""folio: text retrieval and text analytics on Spark DataFrames."""
