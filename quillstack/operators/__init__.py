"""DataFrame operators: trees, files, jobs, blocks."""
