"""Training-data operators: one module for each of the ten, plus their queries.

Nothing else in the library imports this subpackage.
"""
