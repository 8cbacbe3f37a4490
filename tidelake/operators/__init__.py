"""Table operators: joins, aggregates, checks, policy rules, governance."""
