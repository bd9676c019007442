"""veilwork: finding, masking and accounting for sensitive data in text, on Spark."""
