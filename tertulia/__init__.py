"""Interview-transcript analytics on PySpark: DataFrame in, DataFrame out."""
