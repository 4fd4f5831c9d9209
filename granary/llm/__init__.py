"""Training-data operators: decontamination, chat rendering, toxicity, extraction, near-dedup, URL rules, line dedup, packing."""
