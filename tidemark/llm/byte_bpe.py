"""Token ids of a public byte-level BPE vocabulary, as little-endian 32-bit integers."""

from __future__ import annotations

import base64
import os
import re
from array import array

#: A space after white space: where cutting at spaces would change the tokens.
_IRREGULAR = re.compile(r"\s ")
#: Distinct units kept per Python worker.
KEPT_UNITS = 300_000


class ByteBPE(dict):
    """Ids per unit that follows a single space, kept for the units seen so far.

    A space between two other characters always begins a token, so such a text is
    the concatenation of its units and their ids. Texts with other white space
    before a space, and units not kept, go to the tokenizer itself.
    """

    _open: dict[tuple[str, str], ByteBPE] = {}

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self._vocabulary, self._full = vocabulary, None

    @classmethod
    def at(cls, vocabulary: str, ranks: str) -> ByteBPE:
        """The worker's own instance."""
        if (vocabulary, ranks) not in cls._open:
            cls._open[vocabulary, ranks] = cls(vocabulary, ranks)
        return cls._open[vocabulary, ranks]

    def __missing__(self, unit: str) -> bytes:
        ids = array("I", self._encode(" " + unit)).tobytes()
        if len(unit) <= 40:
            if len(self) >= KEPT_UNITS:
                self.clear()
            self[unit] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if "<|endoftext|>" in text:  # a special token of the vocabulary, wherever it stands
            if self._full is None:
                os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
                from tokenizers import Tokenizer

                self._full = Tokenizer.from_file(self._vocabulary)
            return array("I", self._full.encode(text, add_special_tokens=False).ids).tobytes()
        if _IRREGULAR.search(text):
            return array("I", self._encode(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", self._encode(first)).tobytes() + b"".join(map(self.__getitem__, rest))
