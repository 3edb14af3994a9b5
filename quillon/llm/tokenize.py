"""Loading a byte-level BPE tokenizer file once per Python worker, and splitting texts as it does."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

#: Pre-token pattern of byte-level BPE (fixed value of the tokenizer family).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters on which every Unicode version agrees; texts with others go through the library itself.
_PLAIN = re.compile(r"[^\t-\r -ɏ‐-‧€]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """One tokenizer file: the library's tokenizer, and a faster engine with the same vocabulary.

    The faster engine is used only if the file is plain byte-level BPE whose merge order is its id
    order; otherwise, and for texts with unusual characters, ``ids`` asks the library.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.plain = (
            spec.get("normalizer") is None
            and spec.get("post_processor") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and model["type"] == "BPE"
            and not model.get("ignore_merges")
            and not model.get("continuing_subword_prefix")
            and not model.get("end_of_word_suffix")
            and all(not (a["single_word"] or a["lstrip"] or a["rstrip"]) for a in spec.get("added_tokens") or [])
        )
        self.regex = regex.compile(PATTERN)
        self.special_split = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.engine = self._engine(model) if self.plain else None

    def _engine(self, model: dict):
        import tiktoken

        letters, vocab = _byte_letters(), model["vocab"]
        order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if order != sorted(order):
            return None
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self.specials}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)

    def ids(self, text: str) -> list[int]:
        """Token ids of a whole text, special strings inside it handled as the library does by default."""
        if self.engine is None or _PLAIN.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if self.special_split is None or not self.special_split.search(text):
            return self.engine.encode_ordinary(text)
        return self.engine.encode(text, allowed_special="all")

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings stood between them."""
        parts = self.special_split.split(text) if self.special_split else [text]
        found: list[str] = []
        for part in parts:
            if self.plain and not _PLAIN.search(part):
                found += self.regex.findall(part)
            else:
                found += [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return found, len(parts) - 1


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
