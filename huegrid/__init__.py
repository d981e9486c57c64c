"""Colour-separation analytics on Spark: images as pixel relations."""
