"""pickwell: collaborative-filtering lists on PySpark DataFrames."""

from pickwell.model import FactorModel

__all__ = ["FactorModel"]
