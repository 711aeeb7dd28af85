"""Named queries over the benchmark tables, each with its check SQL where SQL can express it."""
