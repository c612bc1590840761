"""A JSON document as a stream: the elements of its top-level arrays, one at a time.

Only the element at hand is held.  Keys may come in any order; values of other
keys are passed over without being kept, however large they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Collection, Iterator

#: Characters read at once.
CHUNK = 1 << 20
_STRUCTURE = re.compile(r'"|[{}\[\]]')
_STRING_END = re.compile(r'["\\]')
_BLANK = re.compile(r"[ \t\r\n]*")


class Stream:
    """A text that is read as far as it is needed."""

    def __init__(self, read: Callable[[int], str], chunk: int = CHUNK):
        self._read, self._chunk = read, chunk
        self.text, self.at, self.ended, self.most = "", 0, False, 0

    def more(self) -> bool:
        """Read on; what was passed is let go.  False at the end."""
        if not self.ended:
            # an element longer than a chunk is retried only when twice as much of it is there
            got = self._read(max(self._chunk, len(self.text) - self.at))
            self.ended = not got
            self.text, self.at = self.text[self.at :] + got, 0
            self.most = max(self.most, len(self.text))
        return not self.ended

    def peek(self) -> str:
        """The next character that isn't blank, "" at the end."""
        while True:
            self.at = _BLANK.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, expected: str) -> None:
        if self.peek() != expected:
            raise ValueError(f"{expected!r} expected, {self.peek()!r} found")
        self.at += 1

    def value(self):
        """The next value, parsed."""
        self.peek()
        while True:
            try:
                found, end = json.JSONDecoder().raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:  # a number may go on
                    self.at = end
                    return found
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self.more()

    def skip(self) -> None:
        """Pass over the next value without keeping it."""
        if self.peek() not in '{["':
            self.value()
            return
        depth = 0
        while True:
            m = _STRUCTURE.search(self.text, self.at)
            if m is None:
                self.at = len(self.text)
                if not self.more():
                    raise ValueError("a value has no end")
                continue
            self.at = m.end()
            if m[0] == '"':
                self._skip_string()
            else:
                depth += 1 if m[0] in "{[" else -1
            if depth == 0:
                return

    def _skip_string(self) -> None:
        while True:
            m = _STRING_END.search(self.text, self.at)
            if m is None or m.end() + (m[0] == "\\") > len(self.text):
                self.at = len(self.text) if m is None else m.start()
                if not self.more():
                    raise ValueError("a string has no end")
                continue
            self.at = m.end() + (m[0] == "\\")
            if m[0] == '"':
                return


def elements(stream: Stream, keys: Collection[str]) -> Iterator[tuple[str, object]]:
    """(key, element) of the top-level arrays that ``keys`` name, in the document's order; null counts as an empty array."""
    stream.take("{")
    while stream.peek() != "}":
        key = stream.value()
        stream.take(":")
        if key not in keys or stream.peek() != "[":
            stream.skip()
        else:
            stream.take("[")
            while stream.peek() != "]":
                yield key, stream.value()
                if stream.peek() != "]":
                    stream.take(",")
            stream.take("]")
        if stream.peek() != "}":
            stream.take(",")
    stream.take("}")
    if stream.peek():
        raise ValueError("something follows the document")
