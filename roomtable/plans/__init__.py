"""Registered queries: a Spark callable and, where SQL can say it, its check."""
