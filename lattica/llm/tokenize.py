"""A public tokenizer of the tokenizers library, once in each worker."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; no special tokens are added."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
