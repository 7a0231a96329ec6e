"""Review intelligence and corpus preparation expressed as Spark DataFrame plans."""
