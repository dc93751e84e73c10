"""The catalogue of registered queries and their SQL."""
