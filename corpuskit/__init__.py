"""corpuskit: ingest, audit and prepare large text collections with Spark."""
