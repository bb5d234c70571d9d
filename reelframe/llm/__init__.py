"""Training-data operators: tokenisation, language, quality, de-duplication, search, sharding, packing."""
