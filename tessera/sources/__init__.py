"""Readers of polygon text, GeoJSON and result files (``polygons``), and polygons made from tables (``derived``)."""
