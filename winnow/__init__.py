"""winnow: similarity screening and evaluation of large collections on Spark."""
