"""Ids of byte-level BPE files by the tiktoken library.

A file of the tokenizers library whose merges are in the order of their ids is a table of ranks; tiktoken encodes
whole texts with it several times faster. Both give the same ids (the tests compare them over all code points and on
the tables). tiktoken's regular expressions keep a stack as deep as a run of white space is long and give out near a
million; texts with a run of over 65,536 such characters, and files of another kind, are encoded by the tokenizers library
itself.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
from collections.abc import Callable

#: Fixed value: the split pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return array.array("I", ids).tobytes()


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary by bytes, if the file is plain byte-level BPE whose merges are in the order of their ids."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain = plain and spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if not plain or merged != sorted(set(merged)):
        return None
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


def byte_bpe_encoder(path: str, special_as_text: bool = False) -> Callable[[str], bytes]:
    """Text to ids (little-endian unsigned 32-bit), without added special tokens; strings of special tokens in a text
    give their ids, or with special_as_text are ordinary text. One encoder a worker for each file stays from task to task."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = _made(path, special_as_text)
    return _ENCODERS[key]


#: The longest run of white space that tiktoken gets.
LONG_SPACE = 1 << 16
_SPACE = re.compile(r"\s+")
_ENCODERS: dict[tuple, Callable[[str], bytes]] = {}


def _made(path: str, special_as_text: bool) -> Callable[[str], bytes]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _ranks(spec)
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    odd = any(t[x] for t in spec["added_tokens"] for x in ("lstrip", "rstrip", "single_word", "normalized"))
    if ranks is None or odd and not special_as_text:
        return _by_library(path, special_as_text)
    import tiktoken

    encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
    by_library = functools.cache(lambda: _by_library(path, special_as_text))

    def encoded(text: str) -> bytes:
        if _has_long_space(text):
            return by_library()(text)
        if not special_as_text and any(s in text for s in specials):
            return as_bytes(encoding.encode(text, allowed_special="all"))
        return as_bytes(encoding.encode_ordinary(text))

    return encoded


def _has_long_space(text: str) -> bool:
    return len(text) > LONG_SPACE and any(m.end() - m.start() > LONG_SPACE for m in _SPACE.finditer(text))


def _by_library(path: str, special_as_text: bool) -> Callable[[str], bytes]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = special_as_text
    return lambda text: as_bytes(tokenizer.encode(text, add_special_tokens=False).ids)
