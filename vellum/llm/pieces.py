"""Texts cut into pieces whose tokens do not depend on what stands around them.

A single space between two other characters begins a match of byte-level split patterns,
and no token of a piece vocabulary joins what stands before it to it. So a text is the
run of its pieces, each with the space before it, and a piece is encoded once however
often a task meets it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np

from vellum.llm.common import ship

#: Where a text may be cut: before a single space that stands between other characters.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space at an end or beside a space: such a text is not cut at every space.
ODD = re.compile(r"\A\s|\s\Z| \s|\s ")
#: Pieces that a task remembers from batch to batch; its memory is emptied when full.
REMEMBERED = 400_000
#: Longer pieces are encoded each time.
LONGEST = 400
#: Texts of characters below this one (Latin letters and signs, of old in every version of Unicode) may be encoded by another library of the same rules.
PLAIN = "\u0250"


def pieces_of(text: str) -> list[str]:
    """Pieces of " " + text, without the space that each begins with."""
    return text.split(" ") if text and not ODD.search(text) else [p[1:] for p in CUT.split(f" {text}")]


class Remembered:
    """Values of pieces, computed for many new ones at once."""

    def __init__(self, compute: Callable[[list[str]], Iterable[object]]):
        self.compute = compute
        self.known: dict[str, object] = {}

    def __call__(self, runs: list[list[str]]) -> list[list[object]]:
        """The values of all pieces of each run."""
        met = set().union(*runs) if runs else set()
        new = met - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = met
        order = sorted(new)
        self.known.update(zip(order, self.compute(order), strict=True))
        found = [list(map(self.known.__getitem__, run)) for run in runs]
        for piece in order:
            if len(piece) > LONGEST:
                del self.known[piece]
        return found


def byte_tokenizer(definition: str, plain_specials: bool):
    """A public byte-level tokenizer from its JSON, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def as_ranks(definition: str, pattern: str):
    """A ``tiktoken`` encoding with the rules of a tokenizer's JSON, or None where the JSON asks for more than merges in order of ids."""
    import tiktoken

    rules = json.loads(definition)
    model, before = rules["model"], rules["pre_tokenizer"] or {}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges") or []]
    vocabulary, letters = model["vocab"], byte_letters()
    plain = rules["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"]
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or any(vocabulary.get(m.replace(" ", "")) != 256 + k for k, m in enumerate(merges)):
        return None
    special = {t["content"] for t in rules["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): k for token, k in vocabulary.items() if token not in special}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class ByteIds:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    With the ``pattern`` that the tokenizer splits by, plain texts go through ``tiktoken``,
    which gives the same ids in a third of the time; those with other characters or the
    string of a special token go through ``tokenizers``, piece by piece.
    """

    def __init__(self, definition: str, plain_specials: bool = False, pattern: str | None = None):
        self.tokenizer = byte_tokenizer(definition, plain_specials)
        self.quick = None if pattern is None else as_ranks(definition, pattern)
        self.special = [] if plain_specials else [t["content"] for t in json.loads(definition)["added_tokens"]]
        self.inner = Remembered(lambda pieces: self._packed([f" {p}" for p in pieces]))

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        runs = [pieces_of(text) for text in texts]
        heads = self._packed([run[0] for run in runs])
        return [head + b"".join(rest) for head, rest in zip(heads, self.inner([run[1:] for run in runs]), strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.quick is None:
            return self._by_pieces(texts)
        out: list[bytes] = [b""] * len(texts)
        others = []
        for k, text in enumerate(texts):
            if (text.isascii() or max(text) < PLAIN) and not any(s in text for s in self.special):
                out[k] = np.asarray(self.quick.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()
            else:
                others.append(k)
        for k, ids in zip(others, self._by_pieces([texts[k] for k in others]), strict=True):
            out[k] = ids
        return out


ship(__name__)
