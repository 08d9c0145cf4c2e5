"""Column-level building blocks: missing values, bands, array arithmetic, projections."""
