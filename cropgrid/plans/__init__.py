"""Dataset plans: panel, zoning, climate, training, decision and audit."""
