"""Keyed state over event streams, each with its batch twin."""
