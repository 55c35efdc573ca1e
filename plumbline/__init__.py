"""plumbline: architecture-conformance analytics and data pipelines on PySpark."""
