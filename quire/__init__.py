"""quire: document ETL and ordered-document analytics on Spark DataFrames."""
