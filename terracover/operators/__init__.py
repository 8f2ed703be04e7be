"""Coverage, tiling, routing and statistics operators."""
