"""Training-data operators: tokenizing, deduplication, filtering, chat rendering."""
