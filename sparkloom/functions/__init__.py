"""The operator catalogue; importing it registers all operators."""

from . import binarize, image_graph, images, lists, scalar, strings, windows  # noqa: F401
