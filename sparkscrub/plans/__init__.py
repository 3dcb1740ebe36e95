"""Work that spans rows or jobs: lookups joined back, positional slices, recipes and reports."""
