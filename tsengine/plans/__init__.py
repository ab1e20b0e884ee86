"""Plans: fixture views derived from the driver tables and the operator bundles."""
