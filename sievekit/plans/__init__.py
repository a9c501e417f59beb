"""Named end-to-end queries.  Importing registers them all."""

from . import corpus, files, graph, labels, metrics, models, sequences, similarity, splits, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
