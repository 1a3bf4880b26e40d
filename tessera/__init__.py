"""Tessera: retrieval, document structuring and corpus preparation as Spark dataflows."""
