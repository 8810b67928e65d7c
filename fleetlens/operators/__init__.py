"""Table operators: validation, latest state, spatial joins, metrics."""
