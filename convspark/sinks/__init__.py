"""Writers for the corpus output products (K1-K7)."""
