"""Every operator of this subpackage as a query over the given tables."""

from cohortspark.llm.registry import ORACLES, QUERIES
from cohortspark.llm import alignment, byte_codec, chat_format, inner_products, jaccard_join, line_dedup, mixing, nearest, quality, simhash, structure_repair, token_counts, toxicity  # noqa: F401  (register)

__all__ = ["ORACLES", "QUERIES"]
