"""Training-data operators: ten document, vector and URL operators for corpus preparation."""
