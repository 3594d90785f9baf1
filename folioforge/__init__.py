"""folioforge: document ingestion, normalisation, quality checking and comparison on Spark."""
