"""Relational operators: blocking joins, first rows of groups, merges and versioned folds."""
