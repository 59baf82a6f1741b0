"""Training-data operators: filters, deduplication, mixing and token output for document tables at cluster scale."""
