"""corpusmill: corpus curation, balancing, de-duplication, retrieval and evaluation on PySpark."""
