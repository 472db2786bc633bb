"""Operator families; importing this package registers them all."""

from . import colour, converter, develop, geometry, iterative, masks, mixing, patchfill, plumbing, retouch, spots, stencil, textures  # noqa: F401
