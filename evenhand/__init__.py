"""evenhand: class-imbalance analytics on PySpark DataFrames."""
