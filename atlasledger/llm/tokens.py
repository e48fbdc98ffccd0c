"""Token ids of whole texts with the ``tokenizers`` library, as packed little-endian bytes.

The vocabulary's split pattern never joins what stands on either side of a single space, and encodes
each split word alone. So a text falls into chunks between spaces and those into words, and a worker
remembers the ids of chunks and words it has met. Texts in which a space ends a longer run of white
space, or with characters outside the plain Latin blocks, where two libraries' Unicode tables might
differ, are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable

#: Strings of either kind (words, chunks) that a worker remembers at most, in all some 170 MB.
OFTEN, ONCE = 400_000, 300_000
# fixed values: the vocabulary's split pattern, its letter and number classes up to U+024F
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+"
)
_RUN = re.compile(r"\s (?=\s|\Z)")
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_MEMORIES: list[_Memory] = []
_READY: dict[str, Callable[[Iterable[str | None]], list[bytes]]] = {}


def encoder(path: str) -> Callable[[Iterable[str | None]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit integers; null is empty.

    Special tokens' names in a text are ordinary text, and none are added.
    """
    if path not in _READY:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        _READY[path] = _remembering(library)
    return _READY[path]


def forget() -> None:
    """Give back what earlier tasks have left in this worker; tasks of other operators call it."""
    for memory in _MEMORIES:
        memory.forget()


class _Memory:
    """What ``make`` gives for strings, remembered. Strings are known for good once they have come
    twice; those seen once are forgotten first, as most are never seen again."""

    def __init__(self, make: Callable[[list[str]], list[bytes]]) -> None:
        self._make = make
        self._often: dict[str, bytes] = {}
        self._once: dict[str, bytes] = {}
        _MEMORIES.append(self)

    def forget(self) -> None:
        self._often.clear()
        self._once.clear()

    def __call__(self, keys: list[str]) -> list[bytes]:
        often, once = self._often, self._once
        out = list(map(often.get, keys))
        if None not in out:
            return out
        at = [k for k, v in enumerate(out) if v is None]
        new = list(dict.fromkeys(keys[k] for k in at if keys[k] not in once))
        made = dict(zip(new, self._make(new), strict=True)) if new else {}
        for k in at:
            value = made.get(keys[k])
            if value is None:
                value = often[keys[k]] = once[keys[k]]
            out[k] = value
        once.update(made)
        if len(once) > ONCE:
            once.clear()
        if len(often) > OFTEN:
            often.clear()
        return out


def _remembering(library) -> Callable[[Iterable[str | None]], list[bytes]]:
    def packed(texts: list[str]) -> list[bytes]:
        found = library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    words = _Memory(packed)

    def of_chunks(split: list[str]) -> list[bytes]:
        """Ids of what stands between two spaces, with the first of them."""
        found = [_SPLIT.findall(" " + c) for c in split]
        each = iter(words([w for own in found for w in own]))
        return [b"".join([next(each) for _ in own]) for own in found]

    chunks = _Memory(of_chunks)

    def encode(texts: Iterable[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif _RUN.search(text) or _OTHER.search(text):
                out.append(packed([text])[0])
            else:
                first, *rest = text.split(" ")
                out.append(b"".join(words(_SPLIT.findall(first)) + chunks(rest)))
        return out

    return encode
