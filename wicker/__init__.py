"""Graph, text and vector retrieval analytics expressed as Spark plans."""
