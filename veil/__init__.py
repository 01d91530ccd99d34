"""veil: finds, rewrites and privately summarises personal data with Spark."""
