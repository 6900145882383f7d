"""The engine's own queries by name, and their SQL."""

from thicket.plans import code, names, pairs, runs, scores, storage, trees, views, vocab  # noqa: F401
from thicket.plans.registry import QUERIES, SQL  # noqa: F401
