"""Lumenflow: a PySpark-native engine for volumetric-image and vascular-network tables."""

__version__ = "0.1.0"
