"""Column-to-Column functions shared by the operators."""
