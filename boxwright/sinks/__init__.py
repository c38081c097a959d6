"""Writers and export projections."""
