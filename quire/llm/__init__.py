"""Training-data operators: archives, deduplication, tokenizing, language and quality."""
