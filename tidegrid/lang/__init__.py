"""Query languages."""
