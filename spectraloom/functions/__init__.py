"""Part of spectraloom."""
