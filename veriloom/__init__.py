"""veriloom: an evidence and corpus engine expressed as PySpark DataFrames."""
