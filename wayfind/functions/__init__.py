"""Column functions: text analysis, HTML, URLs, dates, snippets."""
