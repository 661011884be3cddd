"""corpusmill: corpus curation and analytics as composable PySpark DataFrame operators."""
