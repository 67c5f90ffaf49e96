"""Physical operators: exact grouping, similarity search, greedy selection, ranking, diversification."""
