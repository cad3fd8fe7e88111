"""Tables of chemical entities on Spark DataFrames."""

from .frame import FEAT, META, OBJ, EntityFrame, HistoryEntry

__all__ = ["FEAT", "META", "OBJ", "EntityFrame", "HistoryEntry"]
