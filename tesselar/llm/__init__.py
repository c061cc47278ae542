"""Training-data operators: decontamination, scoring, near-duplicates, sharding, tokens and chat formatting."""
