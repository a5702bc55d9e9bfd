"""docsift: document extraction and evaluation analytics on PySpark."""
