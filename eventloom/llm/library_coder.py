"""Encoding by the ``tokenizers`` library, one call for all new pieces of some texts."""

from __future__ import annotations

import os

from eventloom.llm import common, pretoken
from eventloom.llm.bpe import byte_letters


def library_cache(path: str) -> pretoken.PieceCache:
    """The worker's cache for a vocabulary file, kept between tasks."""
    return common.kept(("library", path), lambda: _made(path))


def _made(path: str) -> pretoken.PieceCache:
    """A cache of ids that the library gives, made once in a Python worker process.

    New words are encoded by library calls for all of them: those of letters and
    punctuation (see ``pretoken``) by their distinct pieces, spelt in the letters that
    the library's model has for bytes, so that no pattern runs again; the others as
    words.  A text that isn't plain is encoded by the library as a whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    from tokenizers import Tokenizer, pre_tokenizers

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    specials = tuple(t.content for t in library.get_added_tokens_decoder().values())
    model = Tokenizer(library.model)
    model.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
    # byte -> letter in UTF-16; pieces hold no line feed, which stays as the border between them
    letters = np.zeros(256, "<u2")
    for letter, byte in byte_letters().items():
        letters[byte] = ord(letter)
    letters[10] = 10

    def text_ids(text: str) -> bytes:
        return np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def divided(got, count: int) -> list[bytes]:
        ids = np.asarray(got.ids, "<u4").tobytes()
        cut = (4 * np.searchsorted(np.asarray(got.word_ids), np.arange(count + 1))).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def piece_ids(pieces: list[str]) -> list[bytes]:
        spelt = letters[np.frombuffer("\n".join(pieces).encode(), np.uint8)].tobytes().decode("utf-16-le")
        return divided(model.encode(spelt, add_special_tokens=False), len(pieces))

    def other_ids(words: list[str]) -> list[bytes]:
        return divided(library.encode(words, is_pretokenized=True, add_special_tokens=False), len(words))

    def word_ids(words: list[str]) -> list[bytes]:
        return pretoken.encode_simply(words, piece_ids, other_ids)

    return pretoken.PieceCache(word_ids, text_ids, text_ids("\n"), specials, limit=1_000_000)
