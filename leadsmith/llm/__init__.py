"""Training-data operators: quality rules, PII, packing, near and exact duplicates, BPE, language-model scores, toxicity."""
