"""Column functions for identifiers, lineages and labels."""
