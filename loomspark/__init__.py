"""loomspark: relational, graph, retrieval, matching and evaluation operators as Spark DataFrame plans."""
