"""Code-graph analytics as DataFrame plans."""
