"""Text retrieval: chunks with exact offsets, and ranking by words. An extension: the reference only names them."""

from .bm25 import rank_documents
from .chunks import chunk_words

__all__ = ["chunk_words", "rank_documents"]
