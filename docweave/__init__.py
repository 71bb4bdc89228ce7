"""Document analytics on Spark: scans, normalisation, search, grading and export as DataFrame plans."""
