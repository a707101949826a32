"""Part of swatchwork."""
