"""Queries over the tables of a folder, each with its SQL twin."""
