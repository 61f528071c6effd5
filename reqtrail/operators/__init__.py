"""DataFrame operators: joins, ranking, filters, groups, statistics, scorers."""
