"""Column expressions: identifiers, statuses, texts, geometry."""
