"""Training-data operators: tokenizing, scoring, deduplicating, packing and searching."""
