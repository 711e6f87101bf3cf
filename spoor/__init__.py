"""spoor: spatio-temporal lineage analytics on PySpark."""
