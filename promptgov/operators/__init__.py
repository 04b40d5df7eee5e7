"""DataFrame operators: joins, windows, folds and aggregations."""
