"""Code-corpus analytics on Spark: declarative operators for preparing, checking and evaluating code datasets."""
