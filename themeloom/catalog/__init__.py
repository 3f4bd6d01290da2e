"""One runnable query per operator, with equivalent SQL where SQL can say it."""

from themeloom.catalog import personal, points, sources, text, topics  # noqa: F401
from themeloom.catalog.registry import ORACLES, QUERIES  # noqa: F401
