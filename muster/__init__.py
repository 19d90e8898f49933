"""Query runs, usage ledgers and worker-pool audits on PySpark DataFrames."""
