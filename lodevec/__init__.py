"""lodevec: vector, text and training-data retrieval expressed as Spark plans."""
