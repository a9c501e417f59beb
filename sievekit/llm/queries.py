"""All queries of this subpackage."""

from __future__ import annotations

from . import conversation_repair, language_id, licenses, lm_scoring, merkle, near_dedup, packing, quality, quality_classifier, sharding, spotsigs, substring_dedup, word_bpe  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
