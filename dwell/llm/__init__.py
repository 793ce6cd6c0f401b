"""Training-data operators: near duplicates, language, leaks, tokens, packing, toxicity."""
