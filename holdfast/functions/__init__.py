"""Column functions: no DataFrame, no action, only expressions Catalyst can see through."""
