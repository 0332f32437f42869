"""Public tokenizers, loaded once in each Python worker; their files stay where they are installed."""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Callable

import numpy as np


@functools.lru_cache(2)
def byte_bpe(path: str | None = None) -> Callable[[str], np.ndarray]:
    """Encodes a text into byte-level BPE ids (uint32); strings of special tokens are ordinary text.

    ``path`` names a file of ranks; by default the installed ``byte_bpe_50k.tiktoken``,
    the same vocabulary as ``byte_bpe_50k.json``: the ids are equal (tested), at a
    third of the CPU time.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    core = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    nothing: set[str] = set()

    def encode(text: str) -> np.ndarray:
        return np.frombuffer(core.encode_to_tiktoken_buffer(text, nothing), np.uint32)

    return encode


@functools.lru_cache(2)
def document_bpe(path: str | None = None) -> Callable[[str], np.ndarray]:
    """``byte_bpe`` as ``byte_bpe_50k.json`` encodes by default: the string of an added token is that token's one id.

    A file of ranks that ``path`` names has no added tokens.
    """
    import public_tokenizers

    plain = byte_bpe(path)
    if path is not None:
        return plain
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {t["content"]: t for t in json.load(f)["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added.values()):
        raise ValueError("added tokens that look at their neighbours are not supported")
    if not added:
        return plain
    ids = {c: np.array([t["id"]], np.uint32) for c, t in added.items()}
    split = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")").split

    def encode(text: str) -> np.ndarray:
        parts = split(text)
        if len(parts) == 1:
            return plain(text)
        return np.concatenate([ids[p] if k % 2 else plain(p) for k, p in enumerate(parts)])

    return encode


@functools.lru_cache(2)
def sentence_pieces(path: str | None = None):
    """The installed SentencePiece model's processor (for its vocabulary and as the reference in tests)."""
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
