"""quire: document analytics and retrieval as Spark DataFrame operators."""
