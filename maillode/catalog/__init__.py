"""The registered queries and their reference SQL, by theme."""

from . import archive, detect, incremental, listing, mail, reports  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
