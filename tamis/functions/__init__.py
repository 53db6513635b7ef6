"""Column-expression helpers, fixed value lists and the ordered-scan engine."""
