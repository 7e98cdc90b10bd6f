"""Plans of the capacity model: facts, metrics, quality checks and reader queries."""
