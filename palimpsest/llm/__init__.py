"""Training-data operators: deduplication, packing, tokens, language, toxicity, quality, pages."""
