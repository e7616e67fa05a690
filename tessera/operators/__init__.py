"""Part of the corpus analytics library."""
