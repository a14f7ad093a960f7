"""Column-level helpers: time, coercion, predicates, patterns and labels."""
