"""Registered queries and their SQL, by family."""

from . import rotation, spectral, sphere, sums

FAMILIES = (spectral, sphere, sums, rotation)
