"""Findings of the third round."""

import random
from array import array

import pyarrow as pa
from tokenizers import Tokenizer

from eventloom.llm import bpe, common, frequencies, library_coder, pretoken, url_filter


def test_rules_of_the_contract(spark):
    urls = ["http://a.com/en/x", "http://b.example.com/en/7", "http://a.net/de/x", "http://example.net/de/7", "http://example.net/de/8", "http://org/es/", "http://net/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.apply_rules(pages, url_filter.rule_frame(spark, url_filter.RULES), ["page_id"]).orderBy("page_id").collect()
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")]
    assert [(x.rule, x.verdict) for x in got] == want
    assert "('allow', 'net', '/de/')" in url_filter.SQL


def test_pieces_are_merged_together_as_one_by_one():
    vocabulary, draw = bpe.Vocabulary(bpe.default_tokenizer()), random.Random(3)
    pieces = [b"", b"a", b" the", bytes(range(256)), b"a" * 64, b"ab" * 40, *(bytes(draw.choices(b"aeionrst h", k=draw.randint(1, 70))) for _ in range(400)), *(draw.randbytes(draw.randint(1, 20)) for _ in range(200))]
    want = [array("I", vocabulary.merge(p)).tobytes() for p in pieces]
    assert vocabulary.merge_all(pieces) == want and vocabulary.merge_all([]) == []


def test_words_are_found_together(tmp_path):
    vocabulary = bpe.Vocabulary(bpe.default_tokenizer())
    words = [b" the", b" then", b" other", b"x", "é".encode()]
    file = tmp_path / "lexicon"
    file.write_bytes(bpe.compile_lexicon(words, vocabulary))
    lexicon = bpe.Lexicon(str(file))
    asked = [*words, b" th", b"", b" thens", b"y", b"x"]
    assert [lexicon.ids_of(n) for n in lexicon.numbers(asked).tolist()] == [*(array("I", vocabulary.merge(w)).tobytes() for w in words), None, None, None, None, array("I", vocabulary.merge(b"x")).tobytes()]
    assert len(lexicon.numbers([])) == 0


def test_each_text_is_looked_up_once():
    asked = []

    def encode(words):
        asked.extend(words)
        return [f"[{w}]".encode() for w in words]

    cache = pretoken.PieceCache(encode, lambda t: b"?", b"/", ("<s>",))
    assert cache.encode(["a b a\nb c", "", "a  b", "x<s>", "a b"]) == [b"[a][ b][ a]/[b][ c]", b"", b"?", b"?", b"[a][ b]"]
    assert sorted(asked) == [" a", " b", " c", "a", "b"]
    assert cache.encode(["b a"]) == [b"[b][ a]"] and len(asked) == 5
    assert not hasattr(pretoken, "_Known")  # texts were joined twice where a word was new


def test_both_coders_agree_with_the_library():
    library = Tokenizer.from_file(bpe.default_tokenizer())
    texts = ["Word. word, été; x! don't. 5. a.. é? ß: don? s. 're. ..", ". a. b .c", "Word. ten.\nten. word!", "ſ. Ā, ÷. ×! º. a"]
    want = [array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert library_coder._made(bpe.default_tokenizer()).encode(texts) == want
    assert bpe.Coder(bpe.default_tokenizer(), None, bpe.library_newer(bpe.default_tokenizer())).encode(texts) == want


def test_blocks_let_go_what_workers_keep(spark):
    def held(batches):
        for batch in batches:
            common.kept("large", lambda: b"x" * 1000)
            yield batch

    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(common._KEPT)], pa.int32())})

    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").coalesce(1)
    spark.range(64).repartition(16).mapInArrow(held, "id long").count()
    frequencies.blocks(docs.unionByName(spark.range(64).repartition(16).selectExpr("id doc_id", "'a' text"))).count()
    assert {x.n for x in spark.range(16).repartition(4).mapInArrow(told, "n int").collect()} == {0}
