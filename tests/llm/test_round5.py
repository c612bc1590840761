"""Findings of the fourth round."""

import random
import string
import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from eventloom.llm import bpe, pretoken, quality

PATH = bpe.default_tokenizer()


def test_simple_words_take_no_pattern():
    coder, asked = bpe.Coder(PATH, None, bpe.library_newer(PATH)), []
    pattern = coder.cut
    coder.cut = lambda word: asked.append(word) or pattern(word)
    texts = ["Wort*** und&&& schön. x1 don't", "***\n&& öä%%% und*** x1"]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [memoryview(x).cast("I").tolist() for x in coder.encode(texts)] == want
    assert sorted(asked) == [" don't", " x1"]  # every word was cut by the pattern


def test_pieces_of_simple_words_are_encoded_once():
    asked, others = [], []
    pieces = lambda p: asked.extend(p) or [f"[{x}]".encode() for x in p]
    rest = lambda w: others.extend(w) or [b"?"] * len(w)
    got = pretoken.encode_simply([" und***", " und&", " ***", "x", " 中!", "", " und"], pieces, rest)
    assert got == [b"[ und][***]", b"[ und][&]", b"[ ***]", b"[x]", b"?", b"", b"[ und]"]
    assert sorted(asked) == [" ***", " und", "&", "***", "x"] and others == [" 中!"]
    assert pretoken.encode_simply([], pieces, rest) == []


def test_simple_letters_and_marks_are_such_to_the_library():
    ask = Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str
    chars = [chr(c) for c in range(0x3000)]
    (letters, marks), simple = pretoken.simple_pieces(pa.array(chars, pa.large_string()))
    found = [c for c, s in zip(chars, simple.to_pylist()) if s]
    for c, a, b in zip(found, letters.to_pylist(), marks.to_pylist()):
        assert (a == c and unicodedata.category(c)[0] == "L" and len(ask("a" + c)) == 1) or (b == c and c in string.punctuation and len(ask("." + c)) == 1), hex(ord(c))
    assert len(found) == 52 + 32 + 398


def test_pieces_are_counted_over_every_text(spark):
    draw, newer = random.Random(4), bpe.library_newer(PATH)
    words = ["und***", "und", "x1&", "schön.", "***", "中!", "don't", "é", ""]
    texts = [draw.choice(" \n").join(draw.choices(words, k=draw.randint(0, 30))) for _ in range(200)]
    want: Counter[str] = Counter()
    for t in texts:
        for word in t.replace("\n", " ").split(" ") if t else ():
            want.update(pretoken.cutter(newer)(" " + word))
    docs = spark.createDataFrame([*((t,) for t in texts), (None,)], "text string").repartition(3)
    first = sorted((p for p, n in want.items() if n > 1), key=lambda p: (-want[p], p))
    assert bpe.frequent_pieces(docs, "text", 100, newer) == [p.encode() for p in first]


def test_training_takes_little_of_the_driver():
    draw = np.random.default_rng(2)
    rows = []
    for i in range(400):
        x = [np.unique(draw.integers(0, quality.BUCKETS, 1500)).astype(np.int32) for _ in range(4)]
        rows.append(([(b, np.full(len(b), 1 / 1500, np.float32)) for b in x], i % 2))
    features = sum(len(b) for x, _ in rows for b, _ in x)
    tracemalloc.start()
    quality.fit(rows, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # indexes and values, the weights with their steps, and what a few rows take; before, 40 bytes a feature beside the weights
    assert peak < 8 * features + 7 * 8 * 4 * quality.BUCKETS + (16 << 20)
