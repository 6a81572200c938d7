"""DataFrame operators: joins, sequence building, estimators, scoring, search."""
