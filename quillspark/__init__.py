"""quillspark: retrieval, task analytics and corpus preparation on PySpark."""
