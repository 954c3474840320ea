"""Column-level helpers: clocks, number rules, wikitext patterns and marker counts."""
