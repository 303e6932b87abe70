"""Geometry as columns (``geometry``), on NumPy arrays (``kernels``), and repair (``repair``)."""
