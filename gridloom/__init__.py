"""Curation, quality control and sampling of very large collections of tiled images, as Spark plans."""
