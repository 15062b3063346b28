"""payguard: payment-fraud analytics on Spark DataFrames."""
