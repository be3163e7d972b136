"""Plan shapes shared by the operators: ordered totals, bounded joins, top-k, durable cuts."""
