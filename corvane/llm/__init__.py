"""Training-data operators: quality, deduplication, tokenisation, extraction, decontamination."""
