"""Operators: index, ranks, search, interactions, crawl."""
