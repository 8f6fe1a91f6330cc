"""Column expressions: no actions, no Python in the plan."""
