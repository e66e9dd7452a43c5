"""Lodestone: PySpark operators that audit and prepare a large document corpus."""
