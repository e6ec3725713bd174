"""Column-level functions: histograms, sketches, key templates, scalars."""
