"""A PySpark engine that turns public text records into auditable demand evidence."""
