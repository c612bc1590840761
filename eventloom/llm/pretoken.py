"""Cutting texts into the pieces that a byte-level BPE encodes one by one.

A byte-level BPE first cuts a text by a fixed pattern and then merges inside each
piece, so equal pieces have equal ids wherever they stand.  Most texts are words
between single blanks and line feeds; for those, cutting at a blank that has
non-blanks on both sides is exact, and it is much cheaper than the pattern.  All
other texts take the pattern (``cut``) or a tokenizer's own way.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

#: White space other than blank and line feed; a text with any of it is not plain, nor is one with white space at an end or two together.
_OTHER_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")
_NOT_PLAIN = rf"\A[ \n]|[ \n]\z|[ \n][ \n]|[{''.join(f'\\x{{{ord(c):x}}}' for c in _OTHER_SPACE)}]"
#: Latin letters that every Unicode table has, then ASCII punctuation: two pieces at most, whatever the tables.
_SIMPLE = r"\A(?P<letters>(?: ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)?)(?P<marks>(?: ?[!-/:-@\[-`{-~]+)?)\z"


def simple_pieces(words):
    """Of an Arrow array of words: the letters and the punctuation of those that are no more, either may be empty, and which these are."""
    import pyarrow.compute as pc

    cut = pc.extract_regex(words, _SIMPLE)
    simple = cut.is_valid()
    two = cut.filter(simple)
    return (two.field("letters"), two.field("marks")), simple


def encode_simply(
    words: list[str], encode_pieces: Callable[[list[str]], list[bytes]], encode_others: Callable[[list[str]], list[bytes]]
) -> list[bytes]:
    """Ids of each word: of letters followed by punctuation by its two pieces, of any other as ``encode_others`` says.

    ``encode_pieces`` gets each distinct piece once.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    given = pa.array(words, pa.large_string())
    both, simple = simple_pieces(given)
    halves, n = pa.concat_arrays(both), len(both[0])
    coded = pc.if_else(pc.equal(halves, ""), pa.scalar(None, halves.type), halves).dictionary_encode()
    pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    ids = pa.array(encode_pieces(pieces) if pieces else [], pa.large_binary()).take(coded.indices)
    joined = pc.binary_join_element_wise(ids[:n], ids[n:], pa.scalar(b"", pa.large_binary()), null_handling="replace")
    out = joined.to_numpy(zero_copy_only=False).tolist()
    if len(out) == len(words):
        return out
    others = iter(encode_others(given.filter(pc.invert(simple)).to_pylist()))
    found = iter(out)
    return [next(found) if s else next(others) for s in simple.to_pylist()]


def newer_characters(pre_tokenize: Callable[[str], list]) -> str:
    """A character class of code points that only newer Unicode tables assign.

    The ``regex`` module may know letters and numbers that the tables of the
    tokenizer don't have yet; the pattern must not take them for such.  Every code
    point that this Python's tables don't assign but ``regex`` does is put to the
    tokenizer's own ``pre_tokenize`` beside a letter and beside a digit.
    """
    import regex

    absent = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")
    asked = regex.findall(r"[\p{L}\p{N}]", absent)
    spans: list[list[int]] = []
    for c in (ord(x) for x in asked if len(pre_tokenize("a" + x)) > 1 and len(pre_tokenize("1" + x)) > 1):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans)


def cutter(newer: str) -> Callable[[str], list[str]]:
    """The GPT-2 pre-tokenization pattern as a function text -> pieces.

    ``newer``: what ``newer_characters`` returns, found once by the driver.
    """
    import regex

    letter, number = (f"[\\p{{{x}}}--[{newer}]]" if newer else f"\\p{{{x}}}" for x in "LN")
    other = f"[^\\s\\p{{L}}\\p{{N}}]" if not newer else f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{newer}])"
    # the pattern is a fixed value of the vocabulary's format
    return regex.compile(
        rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"
    ).findall


class PieceCache:
    """Ids of texts (uint32, little-endian) from cached ids of their words.

    ``encode_pieces`` encodes a list of distinct words; ``encode_text`` encodes a
    text that is not plain.  A cache of more than ``limit`` words is cut before the next
    texts; the words seen first, which the frequent ones are among, stay.
    """

    def __init__(
        self,
        encode_pieces: Callable[[list[str]], Iterable[bytes]],
        encode_text: Callable[[str], bytes],
        newline: bytes,
        specials: tuple[str, ...],
        limit: int = 400_000,
    ):
        self.encode_pieces, self.encode_text = encode_pieces, encode_text
        self.newline, self.specials, self.limit = newline, specials, limit
        # ids of a word after a blank, and of a line feed with the word behind it
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; cut the list so that it holds a few MB.

        Arrow cuts the texts, numbers the distinct words and puts their ids in a
        row; Python sees each distinct word once.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = self.known
        if len(known) > self.limit:
            for k in list(known)[self.limit // 4 :]:
                del known[k]
        given = pa.array(texts, pa.large_string())
        odd = pc.or_(pc.equal(pc.binary_length(given), 0), pc.match_substring_regex(given, _NOT_PLAIN))
        for special in self.specials:
            odd = pc.or_(odd, pc.match_substring(given, special))
        plain = given.filter(pc.invert(odd))
        # every line begins with its line feed, the first one too
        lines = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(plain, "\n", " \n"), pa.scalar("", pa.large_string()))
        cut = pc.split_pattern(lines, " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        each = list(map(known.get, words))
        # all new words in one call
        if at := [i for i, x in enumerate(each) if x is None]:
            new = [words[i] for i in at]
            for i, w, x in zip(at, new, self.encode_pieces([w[1:] if w[0] == "\n" else " " + w for w in new])):
                known[w] = each[i] = self.newline + x if w[0] == "\n" else x
        ids = pa.array(each, pa.large_binary()).take(coded.indices)
        data = memoryview(ids.buffers()[2] or b"")
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[cut.offsets.to_numpy()].tolist() if len(ids) else []
        spans, first = zip(ends, ends[1:]), len(self.newline)
        out = []
        for text, other in zip(texts, odd.to_pylist()):
            if other:
                out.append(self.encode_text(text) if text else b"")
            else:
                a, b = next(spans)
                out.append(bytes(data[a + first : b]))
        return out
