"""BPE encoding and decoding by a minimal acyclic transducer over frequent words.

The driver compiles the corpus's most frequent pieces with their ids into one
automaton whose suffixes are shared; the file is memory-mapped by every Python
worker.  A piece outside the automaton is merged exactly, so the lexicon decides
speed and never the result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import common, pretoken

#: Pieces that the automaton holds at most; the rest is merged.
LEXICON_WORDS = 1 << 15
#: Longer pieces are rare and stay out of the automaton, in UTF-8 bytes.
LEXICON_BYTES = 48
#: Text encoded at once in a worker, in UTF-8 bytes.
STEP_BYTES = 2 << 20
#: Distinct words a worker counts before it hands its counts on.
COUNTED_WORDS = 300_000
#: Pieces up to these lengths in bytes are merged together, so many at a time; longer ones one by one.
MERGE_BANDS, MERGE_ROWS = (8, 16, 32, 64), 1 << 14
_HEAD = struct.Struct("<8sIIII")
_MAGIC = b"EVFST01\n"


def default_tokenizer() -> str:
    """Path of the vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies, as letter -> byte.

    Bytes that print as they are keep their own letter; the others take, in order,
    the letters from U+0100 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE vocabulary: merges by rank, bytes of ids, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] is not None:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        vocab: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.specials.values()])
        #: UTF-8 bytes that each id stands for
        self.bytes: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.base = [0] * 256
        for letter, b in letters.items():
            self.base[b] = vocab[letter]
        #: pair of ids -> rank, and the id that the pair of a rank becomes
        self.rank: dict[tuple[int, int], int] = {}
        self.becomes: list[int] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((vocab[a], vocab[b]), len(self.becomes))
            self.becomes.append(vocab[a + b])
        # the same as arrays, the pairs in order, and the ranks of all pairs of bytes
        pairs = sorted((a << 32 | b, r) for (a, b), r in self.rank.items())
        self._pairs, self._ranks = np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32)
        self._base, self._becomes = np.array(self.base, np.int32), np.array(self.becomes, np.int32)
        self._byte_ranks = self._rank_of(np.repeat(self._base, 256), np.tile(self._base, 256))

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; what isn't merged, and a pair with -1, has the number of ranks."""
        if not len(self._pairs):
            return np.zeros(a.shape, np.int32)
        pair = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._ranks[at], np.int32(len(self.becomes)))

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` of each piece, as little-endian unsigned 32-bit integers; all pieces take their next step at once."""
        out, lengths = [b""] * len(pieces), np.array([len(p) for p in pieces], np.int64)
        low = 0
        for high in MERGE_BANDS:
            some = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(some), MERGE_ROWS):
                self._merge_band(pieces, some[at : at + MERGE_ROWS], lengths, high, out)
            low = high
        for i in np.flatnonzero(lengths > low).tolist():
            out[i] = array("I", self.merge(pieces[i])).tobytes()
        return out

    def _merge_band(self, pieces: list[bytes], rows: np.ndarray, lengths: np.ndarray, width: int, out: list[bytes]) -> None:
        """The pieces of ``rows``, each of ``width`` bytes at most: a row of ids each, -1 behind its end."""
        raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in rows.tolist()]), np.uint8).reshape(-1, width)
        size, none = lengths[rows], len(self.becomes)
        place = np.arange(width)
        ids = np.where(place < size[:, None], self._base[raw], np.int32(-1))
        ranks = np.where(place[1:] < size[:, None], self._byte_ranks[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]], np.int32(none))
        while len(rows):
            step = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), step] if ranks.shape[1] else np.full(len(rows), none)
            if len(over := np.flatnonzero(least == none)):
                data, wide = ids[over].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (i, n) in enumerate(zip(rows[over].tolist(), size[over].tolist())):
                    out[i] = data[k * wide : k * wide + 4 * n]
                live = np.flatnonzero(least != none)
                rows, size, ids, ranks, step, least = rows[live], size[live], ids[live], ranks[live], step[live], least[live]
                if not len(rows):
                    return
            # the pair becomes one id, and what follows moves up by one
            every, size = np.arange(len(rows)), size - 1
            ids[every, step] = self._becomes[least]
            place = np.arange(ids.shape[1] - 1)
            ids = np.where(place <= step[:, None], ids[:, :-1], ids[:, 1:])
            ranks = np.where(place[:-1] < step[:, None], ranks[:, :-1], ranks[:, 1:])
            k = np.flatnonzero(step < ranks.shape[1])
            ranks[k, step[k]] = self._rank_of(ids[k, step[k]], ids[k, step[k] + 1])
            k = np.flatnonzero(step > 0)
            ranks[k, step[k] - 1] = self._rank_of(ids[k, step[k] - 1], ids[k, step[k]])

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of least rank, leftmost first, is merged until none is left."""
        ids = [self.base[b] for b in piece]
        if len(ids) > 64:
            return self._merge_long(ids)
        none, rank = len(self.becomes), self.rank.get
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i : i + 2] = [self.becomes[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps, for pieces of any length."""
        n, rank = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.becomes[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(p := (ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, p))
            if (h := before[i]) >= 0 and (r := rank(p := (ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, p))
        return [i for i in ids if i >= 0]


def compile_lexicon(words: Iterable[bytes], vocabulary: Vocabulary) -> bytes:
    """The minimal acyclic transducer of ``words`` with their ids, as one block of bytes.

    Words are added in sorted order; a state is frozen as soon as no later word can
    change it and replaced by an equal frozen state if there is one.  A transition
    carries the number of words that sort before those it leads to, so the sum
    along a word's path is the word's number, which indexes the ids.
    """
    ordered = sorted(set(words))
    # a state: [final, [(byte, child), ...]]; frozen states are numbers
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if (n := register.get(key)) is None:
            n = register[key] = len(frozen)
            frozen.append(key)
        return n

    path: list[list] = [[False, []]]
    last = b""
    for word in ordered:
        shared = len(os.path.commonprefix([last, word]))
        while len(path) > shared + 1:
            child = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(child)))
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        child = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(child)))
    root = freeze(path[0])
    count = [0] * len(frozen)
    starts, labels, targets, outs = array("I", [0]), bytearray(), array("I"), array("I")
    for n, (final, edges) in enumerate(frozen):  # children come before their parents
        below = int(final)
        for byte, child in edges:
            labels.append(byte)
            targets.append(child << 1 | frozen[child][0])
            outs.append(below)
            below += count[child]
        count[n] = below
        starts.append(len(labels))
    ids, ends = array("I"), array("I", [0])
    for merged in vocabulary.merge_all(ordered):
        ids.frombytes(merged)
        ends.append(len(ids))
    head = _HEAD.pack(_MAGIC, len(frozen), len(labels), len(ordered), root)
    return head + b"".join(x.tobytes() for x in (starts, targets, outs, ends, ids)) + bytes(labels)


class Lexicon:
    """A memory-mapped automaton made by ``compile_lexicon``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, states, edges, words, self.root = _HEAD.unpack_from(self.map)
        if magic != _MAGIC:
            raise ValueError(f"not a lexicon: {path}")
        view, at = memoryview(self.map), _HEAD.size

        def part(n: int) -> memoryview:
            nonlocal at
            at += 4 * n
            return view[at - 4 * n : at].cast("I")

        self.starts, self.targets, self.outs, self.ends = part(states + 1), part(edges), part(edges), part(words + 1)
        self.ids_at = at
        self.labels_at = at + 4 * self.ends[words]

        # transitions by state and byte, in order
        own = lambda x: np.array(x, np.int64)
        self._steps = np.repeat(np.arange(states, dtype=np.int64), np.diff(own(self.starts))) << 8 | np.frombuffer(self.map, np.uint8, edges, self.labels_at)
        self._targets, self._outs = own(self.targets), own(self.outs)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if the automaton doesn't hold it; all words take their next transition at once."""
        data, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        first, found = np.cumsum(lengths) - lengths, np.full(len(words), -1)
        some, state, number, final, at = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), np.int64), np.zeros(len(words), bool), 0
        while len(some):
            ended = lengths[some] == at
            found[some[ended & final]] = number[ended & final]
            some, state, number = some[~ended], state[~ended], number[~ended]
            step = state << 8 | data[first[some] + at]
            e = np.minimum(np.searchsorted(self._steps, step), len(self._steps) - 1)
            good = self._steps[e] == step
            some, e = some[good], e[good]
            number, state, final, at = number[good] + self._outs[e], self._targets[e] >> 1, self._targets[e] & 1 > 0, at + 1
        return found

    def ids(self, word: bytes) -> bytes | None:
        """Ids of a word (uint32, little-endian), None if the automaton doesn't hold it."""
        return self.ids_of(int(self.numbers([word])[0]))

    def ids_of(self, number: int) -> bytes | None:
        """Ids of the word of a number."""
        return None if number < 0 else self.map[self.ids_at + 4 * self.ends[number] : self.ids_at + 4 * self.ends[number + 1]]


def ship(spark: SparkSession, data: bytes, label: str) -> str:
    """Write ``data`` into the shared folder and hand the file to every executor; returns its name."""
    name = f"{label}-{hashlib.sha256(data).hexdigest()[:16]}-{os.urandom(4).hex()}"
    target = f"{common.shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(target)
    return name


def frequent_pieces(texts: DataFrame, text: str, count: int, newer: str) -> list[bytes]:
    """The ``count`` most frequent pieces of all texts, counted over every text.

    Only texts of words between single blanks and line feeds add to the counts of
    the lexicon (others are encoded by the pattern), which decides speed alone.
    """

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        common.let_go()
        cut = pretoken.cutter(newer)
        seen: Counter[str] = Counter()

        def told() -> Iterator:
            words, counts = pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())
            seen.clear()
            halves, simple = pretoken.simple_pieces(pc.binary_join_element_wise(" ", words, ""))
            known, rest = counts.filter(simple), pc.invert(simple)
            others = [(p, n) for word, n in zip(words.filter(rest).to_pylist(), counts.filter(rest).to_pylist()) for p in cut(" " + word)]
            every = pa.table(
                {
                    "piece": pa.chunked_array([*halves, pa.array([p for p, _ in others], pa.string())]),
                    "n": pa.chunked_array([known, known, pa.array([n for _, n in others], pa.int64())]),
                }
            )
            every = every.filter(pc.and_(pc.greater(pc.binary_length(every["piece"]), 0), pc.less_equal(pc.binary_length(every["piece"]), LEXICON_BYTES)))
            sums = every.group_by("piece", use_threads=False).aggregate([("n", "sum")])
            yield from pa.table({"piece": sums["piece"], "n": sums["n_sum"]}).to_batches()

        for batch in common.pieces(batches, text, STEP_BYTES):
            words = pc.split_pattern(pc.replace_substring(batch.column(0).drop_null(), "\n", " "), " ").flatten().value_counts()
            seen.update(dict(zip(words.field(0).to_numpy(zero_copy_only=False).tolist(), words.field(1).tolist())))
            if len(seen) > COUNTED_WORDS:
                yield from told()
        yield from told()

    found = texts.select(text).mapInArrow(counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    with common.batches_of(texts.sparkSession, STEP_BYTES):
        top = found.filter("n > 1").orderBy(F.desc("n"), "piece").limit(count).select("piece").toArrow()
    return [p.encode() for p in top.column(0).to_pylist()]


class Coder:
    """Encodes and decodes in a Python worker; made once a task."""

    def __init__(self, tokenizer: str, lexicon: str | None, newer: str):
        import pyarrow as pa

        self.vocabulary = Vocabulary(tokenizer)
        self.token_bytes = pa.array(self.vocabulary.bytes, pa.large_binary())
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.cut = pretoken.cutter(newer)
        self.known: dict[str, bytes] = {}
        self.specials = tuple(self.vocabulary.specials)
        self.cache = pretoken.PieceCache(self._words, self._text, array("I", self.vocabulary.merge(b"\n")).tobytes(), self.specials)

    def _learn(self, pieces: list[str]) -> None:
        """Note the ids of pieces: by the automaton, or else merged."""
        raw = [p.encode("utf-8") for p in pieces]
        ids: list[bytes | None] = [None] * len(raw)
        if self.lexicon:
            short = [i for i, r in enumerate(raw) if len(r) <= LEXICON_BYTES]
            for i, number in zip(short, self.lexicon.numbers([raw[i] for i in short]).tolist()):
                if number >= 0:
                    ids[i] = self.lexicon.ids_of(number)
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, merged in zip(rest, self.vocabulary.merge_all([raw[i] for i in rest])):
            ids[i] = merged
        self.known.update(zip(pieces, ids))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of some distinct pieces."""
        if new := [p for p in pieces if p not in self.known]:
            self._learn(new)
        return list(map(self.known.__getitem__, pieces))

    def _others(self, words: list[str]) -> list[bytes]:
        """Ids of each word, cut by the pattern."""
        cut = list(map(self.cut, words))
        distinct = list(set(chain.from_iterable(cut)))
        get = dict(zip(distinct, self._pieces(distinct))).__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        if len(self.known) > self.cache.limit // 4:  # pieces are soon merged again
            self.known.clear()
        return pretoken.encode_simply(words, self._pieces, self._others)

    def _text(self, text: str) -> bytes:
        """Ids of any text: special tokens first, then the pattern."""
        out, at = [], 0
        while True:
            found = [(i, -len(s), s) for s in self.specials if (i := text.find(s, at)) >= 0]
            end, _, special = min(found) if found else (len(text), 0, None)
            out += self._words([text[at:end]])
            if special is None:
                return b"".join(out)
            out.append(struct.pack("<I", self.vocabulary.specials[special]))
            at = end + len(special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.cache.encode(texts)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD as in a lossy decoder."""
        return self.decode_all([ids])[0]

    def decode_all(self, ids: list[bytes]) -> list[str]:
        """``decode`` of each; the bytes of all ids are put in a row by Arrow."""
        import pyarrow as pa

        row = self.token_bytes.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        data, at = memoryview(row.buffers()[2] or b""), np.frombuffer(row.buffers()[1], np.int64, len(row) + 1) if len(row) else np.zeros(1, np.int64)
        cut = at[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [str(data[a:b], "utf-8", "replace") for a, b in zip(cut, cut[1:])]


def coder(tokenizer: str, lexicon: str | None, newer: str) -> Coder:
    """The worker's coder for these files, made at its first task; its cached words serve later ones."""
    return common.kept(("coder", tokenizer, lexicon, newer), lambda: Coder(tokenizer, lexicon, newer))


def library_newer(tokenizer: str) -> str:
    """``pretoken.newer_characters`` for a vocabulary file, by the tokenizers library's tables."""
    from tokenizers import Tokenizer

    return pretoken.newer_characters(Tokenizer.from_file(tokenizer).pre_tokenizer.pre_tokenize_str)


def encode_decode(
    docs: DataFrame, text: str, keys: list[str], tokenizer: str, lexicon_words: int = LEXICON_WORDS, give: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns ``keys``, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex), and
    what ``give`` names: ids (binary, little-endian uint32), decoded (string).  Texts are encoded whole, special tokens in
    them included, without added tokens.  A null or empty text has no ids.  Rows
    are independent: repeated rows give repeated results, an empty table none.
    Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    newer = library_newer(tokenizer)
    words = frequent_pieces(docs, text, lexicon_words, newer)
    lexicon = ship(spark, compile_lexicon(words, Vocabulary(tokenizer)), "lexicon") if words else None
    rows = docs.select(*keys, F.col(text).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema]
    fields += ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    fields += [f"{x} {'binary' if x == 'ids' else 'string'}" for x in give]

    def coded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = coder(tokenizer, SparkFiles.get(lexicon) if lexicon else None, newer)
        for batch in common.pieces(batches, "_text", STEP_BYTES):
            ids = own.encode([t or "" for t in batch.column(len(keys)).to_pylist()])
            decoded = own.decode_all(ids)
            columns = [
                *batch.columns[: len(keys)],
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            ]
            names = [*keys, "n_tokens", "ids_sha256", "decoded_sha256"]
            columns += [pa.array(ids, pa.binary()) if x == "ids" else pa.array(decoded, pa.string()) for x in give]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *give])

    return rows.mapInArrow(coded, ", ".join(fields))


def op9_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` text encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = common.table(spark, sf_dir, "documents")
    return encode_decode(docs, "text", ["doc_id"], default_tokenizer(), give=())
