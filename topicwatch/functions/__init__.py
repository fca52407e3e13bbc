"""Scalar column functions (JVM-side ``pyspark.sql.functions`` compositions)."""
