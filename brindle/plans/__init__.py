"""Plan summaries, the cost model, the advisor and the column cache."""

from .advisor import Advice, advise, summarize
from .cache import ColumnCache
from .cost import CostModel, Density, Node

__all__ = ["Advice", "ColumnCache", "CostModel", "Density", "Node", "advise", "summarize"]
