"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

Texts are encoded by ``tiktoken`` over the ranks in the same file: the same words and merges, without the bookkeeping of character
offsets that makes ``tokenizers`` several times slower. Strings of the file's added tokens become their own ids, as
``tokenizers`` does without being told otherwise. This holds for files whose merges are in the order of their ids, whose words are cut
by the byte-level rule alone, and whose added tokens are plain strings, none the beginning of another; any other file is read by ``tokenizers`` itself, and so is a text
whose white space runs too long for the word rule's regular expression.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

#: Fixed value: how the byte-level rule cuts a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bytes_of() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranked(file: dict) -> bool:
    """Whether ranks alone give the ids of this tokenizer file."""
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if file.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return False
    added = file.get("added_tokens") or []
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        return False
    # Where one is the beginning of another, the longer one wins, which ranks do not promise.
    if any(a is not b and b["content"].startswith(a["content"]) for a in added for b in added):
        return False
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return [model["vocab"].get(m) for m in merges] == list(range(256, 256 + len(merges)))


def loaded(path: str) -> Callable[[str], np.ndarray]:
    """A function from text to ids (unsigned, 32 bits), as ``tokenizers`` gives them for this file without adding special tokens."""
    with open(path, encoding="utf-8") as opened:
        file = json.load(opened)
    slow: list = []

    def by_tokenizers(text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        if not slow:
            slow.append(Tokenizer.from_file(path))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    if not ranked(file):
        return by_tokenizers
    import tiktoken

    to, last = _bytes_of(), 256 + len(file["model"]["merges"])
    ranks = {bytes(to[c] for c in t): i for t, i in file["model"]["vocab"].items() if i < last}
    added = {t["content"]: t["id"] for t in file.get("added_tokens") or []}
    encoding = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=added)
    allowed = set(added)

    def by_ranks(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special=allowed)
        except ValueError:  # the expression ran out of its stack
            return by_tokenizers(text)

    return by_ranks


class Encoder:
    """Encodes texts with one tokenizer file."""

    def __init__(self, path: str):
        self.ids_of = loaded(path)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.ids_of(text).astype("<u4", copy=False).tobytes() if text else b""


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
