"""Typed XML on Spark: nested rows in, compact XML out, and back, as Column expressions."""
