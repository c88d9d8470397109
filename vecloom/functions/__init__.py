"""Functions of the vector engine."""
