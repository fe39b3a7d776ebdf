"""Operators on voxel, label and tile tables."""
