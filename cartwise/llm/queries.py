"""All queries of this folder; importing it registers them."""

from cartwise.llm import bpe, chat, lexical, near_dedup, neighbours, packing, pii, sketches, suffixes, token_counts, token_files, toxicity, whitening  # noqa: F401
from cartwise.llm.registry import ORACLES, QUERIES  # noqa: F401
