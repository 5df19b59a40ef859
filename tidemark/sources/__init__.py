"""Input tables, and entity tables derived from them."""
