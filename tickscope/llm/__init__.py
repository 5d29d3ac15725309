"""Operators of a training-data pipeline and their registered queries."""

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
