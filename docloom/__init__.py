"""docloom: document retrieval and corpus processing as PySpark DataFrame plans."""
