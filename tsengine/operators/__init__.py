"""DataFrame operators: cleaning, joins, window features, aggregations, validation, models."""
