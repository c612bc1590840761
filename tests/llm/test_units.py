"""Parts of the training-data operators that need no Spark."""

import random
import time
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from eventloom.llm import bpe, html_text, passages, pretoken, quality, token_store
from eventloom.llm.exact_topk import Block, best

PATH = bpe.default_tokenizer()
ODD = ["", " ", "\n", " a", "a ", "a  b", "a\n\nb", "x<|endoftext|>y", "<|endoftext|>", "it's we'll 'tis", "a\tb", "é" * 700, "ab" * 900, "½²٣中😀 \x1c\x85", "á b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def newer():
    return bpe.library_newer(PATH)


def texts(n=300, seed=3):
    r = random.Random(seed)
    letters = "abc  \n\t'sdré½²٣中😀_-.,\x1c\x85\xa0"
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_pattern_cuts_as_the_library_does(library, newer):
    cut, ask = pretoken.cutter(newer), library.pre_tokenizer.pre_tokenize_str
    for c in [*range(0x3000), *range(0xA000, 0xD7FF, 3), *range(0x1C80, 0x1CA0), *range(0x10500, 0x11000)]:
        s = "a" + chr(c) + "a1" + chr(c) + " ."
        ends = np.cumsum([0, *map(len, cut(s))]).tolist()
        assert [x[1] for x in ask(s)] == list(zip(ends, ends[1:])), hex(c)


def test_coder_equals_the_library(library, newer, tmp_path):
    every = texts()
    words = {p.encode() for t in every[:150] for p in pretoken.cutter(newer)(t)}
    vocabulary = bpe.Vocabulary(PATH)
    file = tmp_path / "lexicon"
    file.write_bytes(bpe.compile_lexicon(words, vocabulary))
    lexicon = bpe.Lexicon(str(file))
    assert all(lexicon.ids(w) == array("I", vocabulary.merge(w)).tobytes() for w in words)
    assert lexicon.ids(b"\xff\xff") is None and lexicon.ids(b"") is None
    for coder in (bpe.Coder(PATH, str(file), newer), bpe.Coder(PATH, None, newer)):
        for text, ids in zip(every, coder.encode(every)):
            assert list(memoryview(ids).cast("I")) == library.encode(text, add_special_tokens=False).ids, text
            assert coder.decode(ids) == text


def test_decoding_equals_the_library_for_any_ids(library, newer):
    r, coder = random.Random(5), bpe.Coder(PATH, None, newer)
    for _ in range(500):
        ids = [r.randrange(50257) for _ in range(8)]
        assert coder.decode(array("I", ids).tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_lexicon_shares_suffixes():
    vocabulary = bpe.Vocabulary(PATH)
    words = [a + b"ation" for a in (b"n", b"st", b"not", b"rot", b"cre")]
    states = int.from_bytes(bpe.compile_lexicon(words, vocabulary)[8:12], "little")
    assert states < 1 + sum(map(len, words)) // 2


def test_a_full_cache_stays_right(library):
    def encode(words):
        return [np.asarray(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]

    cache = pretoken.PieceCache(encode, lambda t: encode([t])[0], encode(["\n"])[0], ("<|endoftext|>",), limit=40)
    every = [" ".join(f"w{(i * 7 + j) % 97}" for j in range(20)) for i in range(60)]
    for i in range(0, 60, 5):
        assert cache.encode(every[i : i + 5]) == encode(every[i : i + 5])


def test_token_dictionary_of_few_samples():
    for samples in ([], [b"ab"], [b"abcdef" * 50] * 3):
        pack, unpack = token_store._codec(token_store.train_dictionary(samples, 1000))
        assert unpack.decompress(pack.compress(b"abcdef" * 9)) == b"abcdef" * 9


def test_compact_windows_are_the_wide_nodes_of_the_cartesian_tree():
    r = np.random.default_rng(1)
    for _ in range(60):
        rows = [r.integers(0, 2**63 if r.random() < 0.5 else 12, r.integers(0, 50)).astype(np.uint64) for _ in range(r.integers(0, 5))]
        width = int(r.integers(1, 12))
        for f, (row, at, lo, hi, _) in enumerate(passages.compact_windows(np.concatenate([np.empty(0, np.uint64), *rows]), np.array([len(x) for x in rows], np.int64), width, 2)):
            want = set()
            for i, x in enumerate(rows):
                h = passages.mixed(x + np.uint64(0xD1B54A32D192ED03 * (f + 1) & (2**64 - 1)))
                k = [(int(a) >> 28, j) for j, a in enumerate(h)]
                for j in range(len(k)):
                    a = max([q for q in range(j) if k[q] < k[j]], default=-1) + 1
                    b = min([q for q in range(j + 1, len(k)) if k[q] < k[j]], default=len(k)) - 1
                    if b - a + 1 >= width:
                        want.add((i, j, a, b))
            assert set(zip(row.tolist(), at.tolist(), lo.tolist(), hi.tolist())) == want


def test_weighted_windows_leave_unshared_shingles_out():
    r = np.random.default_rng(5)
    for _ in range(60):
        sizes = r.integers(0, 60, r.integers(1, 5))
        values, classes = r.integers(0, 2**63, sizes.sum()).astype(np.uint64), r.integers(0, 4, sizes.sum()).astype(np.uint8) * (r.random(sizes.sum()) < 0.7)
        width = int(r.integers(2, 12))
        for f, (row, at, lo, hi, _) in enumerate(passages.compact_windows(values, sizes, width, 2, classes)):
            want, start = set(), 0
            for i, n in enumerate(sizes.tolist()):
                h = passages.mixed(values[start : start + n] + np.uint64(0xD1B54A32D192ED03 * (f + 1) & (2**64 - 1)))
                c = classes[start : start + n].astype(float)
                k = [-np.log(((int(a) >> 11) + 0.5) / 2**53) * 2**b if b else np.inf for a, b in zip(h, c)]
                start += n
                for j in range(n):
                    a = max([q for q in range(j) if k[q] < k[j]], default=-1) + 1
                    b = min([q for q in range(j + 1, n) if k[q] < k[j]], default=n) - 1
                    if k[j] < np.inf and b - a + 1 >= width:
                        want.add((i, j, a, b))
            assert set(zip(row.tolist(), at.tolist(), lo.tolist(), hi.tolist())) == want


def test_matched_finds_an_edited_passage():
    r = np.random.default_rng(2)
    other = r.integers(0, 2**32, 300).astype("<u4")
    own = np.concatenate((r.integers(0, 2**32, 80), other[100:180], r.integers(0, 2**32, 40))).astype("<u4")
    own[110:114] = r.integers(0, 2**32, 4)
    (first, last, lo, hi, alike, hits), = passages.matched(own, other, 46)
    assert hits.tolist() == [i for i in range(80, 160) if not 110 <= i < 114]
    assert (first, last, lo, hi) == (80, 159, 100, 179) and alike >= 0.75
    assert passages.matched(own[:80], other, 46) == [] == passages.matched(own, own[:0], 46)


def test_cut_words_keeps_the_rest():
    assert passages.cut_words("a b\nc d e", [(1, 3)]) == "a d e"
    assert passages.cut_words(" a b ", [(0, 2)]) == ""
    assert passages.cut_words("a b c", [(2, 3), (1, 3)]) == "a"


def test_base_counts_against_brute_force():
    r = random.Random(4)
    for text in ["", " \n\t", "a b c d e a b c d e", *(" ".join(r.choice("abx|#") for _ in range(r.randint(0, 40))).replace("x", "\n") for _ in range(200))]:
        w = text.encode().split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if x.split()]
        assert quality.base_counts(text, w) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_classifier_separates_held_out_rows():
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["river", "stone", "cloud", "walk", "of", "the"]) + r.choice(["", "s", "ed"]) for _ in range(40))
    bad = lambda: " ".join(r.choice(["WIN!!", "buy|", "$$$", "the", "of***"]) for _ in range(40))
    rows = [(good(), 1) if i % 3 else (bad(), 0) for i in range(240)]

    def features(text):
        out = []
        for buckets, first, number in quality.hashed([text], [text.encode().split()]):
            b, c = np.unique(buckets[: number[0]], return_counts=True)
            out.append((b, c / number[0]))
        return out

    model = quality.fit([(features(t), y) for t, y in rows[:160]])
    p = model.probabilities([t for t, _ in rows[160:]], [t.encode().split() for t, _ in rows[160:]])
    assert np.mean((p >= 0.5) == np.array([y for _, y in rows[160:]])) > 0.97
    assert quality.fit([]).probabilities(["x"], [[b"x"]])[0] > 0.5


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just text", "just text"),
        ("<p", "<p"),
        ("<nav>menu</nav><article><h1>T &amp; x</h1><p>a <b>b</b>c<p>d\n e</article><footer>f</footer>", "T & x a bc d e"),
        ("<article>one<aside>side</aside><div class='comments'><p>no</p></div><form>q</form><script>x='</p>'</script> two</article>", "one two"),
        ("<div class='with-sidebar'><article><p>kept</p></article></div>", "kept"),
        ("<article>x<p title='a>b'>y</article>", "x y"),
        ("<body><ul><li><a>Home</a></ul><p>" + "long words here " * 20 + "</p></body>", None),
        ("<!-- <article>no</article> --><main><p>yes&nbsp;&nbsp;it is</p></main>", "yes it is"),
    ],
)
def test_main_text(page, text):
    got = html_text.main_text(page)
    assert got == text if text is not None else "long words here" in got


def test_very_long_page_in_linear_time():
    page = "<article>" + "<p>word <b>word</b>" * 50_000 + "</article>" + "<" * 20_000
    assert len(html_text.main_text(page)) > 400_000


@pytest.mark.parametrize("part", ['<div class="', "<b></i>", "<a ", '<a b=">" ', "<b><i>", "<p>", "<", "<!-- ", "</x>", '<a title="x>', "<table><td>", "<script "])
@pytest.mark.parametrize("end", ["", ">", "'>", '">'])
def test_odd_markup_in_linear_time(part, end):
    start = time.perf_counter()
    html_text.main_text(part * (2**20 // len(part)) + end)
    assert time.perf_counter() - start < 10


def test_side_elements_by_name():
    body = "long words of a paragraph " * 5
    page = f"<article><div class='article-header'><h1>T</h1></div><p>{body}</p><p class='form-factor'>ff<div class='related-work'><p>rw</div><ul class='share-list'><li>a<li>b<li>c<li>d</ul><div class='ad'>no</div><p>end</article>"
    assert html_text.main_text(page) == f"T {body}".rstrip() + " ff rw end"
    # without an article that holds most of the text all lines count
    page = f"<div class='menu'>m</div><div class='site-header'>h</div><div>{body}</div><article class=card><a href=x>story</a></article><div class=footer>f</div>"
    assert html_text.main_text(page) == f"{body.rstrip()} story"


def test_block_distribution_against_brute_force():
    r = random.Random(9)
    for _ in range(300):
        weight = [r.choice([None, 0, 0, 1, 5, 30, 90]) for _ in range(r.randint(0, 25))]
        window, surge = r.randint(1, 4), r.randint(1, 120)
        sums = [sum(w or 0 for w in weight[i : i + window]) for i in range(len(weight))]
        want = []
        for a in range(len(sums)):
            for b in range(a + 1, len(sums) + 1):
                whole = all(sums[a:b]) and (a == 0 or not sums[a - 1]) and (b == len(sums) or not sums[b])
                if whole and max(sums[a:b]) >= min(surge, max(sums)):
                    want.append((a, b))
        assert html_text.stretches(weight, window, surge) == want


def test_topk_block_against_brute_force():
    r = np.random.default_rng(7)
    rows = np.floor(r.normal(0, 40, (700, 33)))
    queries, top = Block(np.arange(20), list(rows[:20]), 33), [[] for _ in range(20)]
    for i in range(0, 700, 90):
        best(queries, Block(np.arange(i, min(700, i + 90)), list(rows[i : i + 90]), 33), 5, top)
    scores = (rows[:20] @ rows.T).astype(np.int64)
    for q in range(20):
        assert top[q] == sorted((-int(s), j) for j, s in enumerate(scores[q]) if j != q)[:5]
