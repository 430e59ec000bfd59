"""Training-data operators: extraction, personal data, quality, licences, deduplication, mixing and packing."""
