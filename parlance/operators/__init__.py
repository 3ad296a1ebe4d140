"""Relational operators: indexing, retrieval, ranking, dialogue, policy, evaluation."""
