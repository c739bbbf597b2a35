"""binmine: clustering, near-duplicate blocking and evaluation of binary data on Spark."""
