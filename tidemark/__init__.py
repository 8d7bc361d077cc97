"""tidemark: factor analytics, backtesting and training-data operators on PySpark DataFrames."""
