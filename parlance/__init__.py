"""Conversational catalog search and its evaluation, as Spark DataFrame plans."""
