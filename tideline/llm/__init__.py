"""Training-data operators: ten corpus-scale jobs over document and page tables."""
