"""Public tokenizers over many texts: each distinct chunk between spaces is encoded once.

No token of these vocabularies crosses the places where the texts are cut here, so
the ids of a text are those of its chunks, one after another. Chunks seen before are
looked up; the memory of them is bounded and starts anew when it is full, which
changes the work and never the ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Chunks that a task remembers at most.
REMEMBERED = 300_000

#: A space after anything but white space; one right before the text's end stays with the chunk before it.
_CUT = re.compile(r"(?<=\S) (?!\Z)")


def public_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by its published rule: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def id_type(size: int) -> np.dtype:
    """Two bytes for an id where the vocabulary allows it, else four."""
    return np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)


class Remembered(dict):
    """Answers by chunk; ``answer`` maps a list of unknown chunks to theirs."""

    def __init__(self, answer: Callable[[list], list], most: int = REMEMBERED):
        super().__init__()
        self.answer, self.most = answer, most

    def learn(self, chunks: set) -> dict:
        """The answers of unknown ``chunks``, kept for later. A full memory keeps its older half, as common chunks come early."""
        asked = list(chunks)
        new = dict(zip(asked, self.answer(asked), strict=True))
        if len(self) + len(new) > self.most:
            for c in list(self)[self.most // 2 :]:
                del self[c]
        self.update(new)
        return new


def word_chunks(text: bytes) -> list[bytes]:
    """Runs without ASCII white space: for vocabularies that drop white space and keep no token across it."""
    return text.split()


def space_chunks(text: str) -> list[str]:
    """Cuts at single spaces after a visible character; the space belongs to the chunk behind it and is left out."""
    return _CUT.split(text)
