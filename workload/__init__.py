from . import graph, logs, sources, tables, values  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
