"""shabdagrid: text retrieval and knowledge-graph analytics as PySpark plans."""
