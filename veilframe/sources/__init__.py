"""Text corpora in, masked corpora out."""
