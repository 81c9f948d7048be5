"""orfweave: gene calling and genetic-code detection over DNA collections, as PySpark DataFrame plans."""
