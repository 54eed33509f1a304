"""Training-data operators: dedup, tokens, joins, classifiers, extraction, mixing."""
