"""All registered queries of the reference operators: importing the modules that define them fills the tables."""

from . import bindings, state, surface  # noqa: F401
from .bindings import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
