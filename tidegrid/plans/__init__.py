"""From parsed queries to one lazy DataFrame plan."""
