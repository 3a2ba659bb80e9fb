"""loomdoc: document retrieval analytics and corpus processing as plain Spark DataFrame plans."""
