"""Sources and sinks of pages, rules, word lists and results."""
