import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from clearway.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)
ENCODER = packing.WordEncoder(VOCABULARY)
ODD = ["it's don'T WE'VE", "É́ é ﬁ ½ ² ª µ ß İ Σς x\u0085y z", "a<|endoftext|>b <|startoftext|>", "a\x1cb \x1f", "日本語 ABC123,45!!", "x" * 300, "­soft", "", " \n\t"]


def ids(text):
    return np.frombuffer(ENCODER.encode(text), dtype="<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_tokenizers(text):
    assert ids(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" '<|>.,stmlédÉ\n")), max_size=60))
def test_ids_of_any_text(text):
    assert ids(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAzZ019'.,<|>&~\x01\x7f "), max_size=12))
def test_ids_of_short_words(text):
    assert ids(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("'stremvld !.\n\x0b"), st.characters(max_codepoint=255)), max_size=40))
def test_ids_of_latin_texts(text):
    assert ids(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("more", ["", " 日本"])
def test_frequent_words_are_learned_once(monkeypatch, more):
    """Also when new words fill the memory again and again; ids stay right and the memory bounded."""
    monkeypatch.setattr(packing, "REMEMBERED", 30)
    learned = []

    class Counting(packing.WordEncoder):
        def _learn(self, word):
            learned.append(word)
            return super()._learn(word)

        def _learn_part(self, part):
            learned.append(part)
            return super()._learn_part(part)

    encoder = Counting(VOCABULARY)
    letters = "abcdefghij"
    for n in range(100):
        new = letters[n // 10] + letters[n % 10]
        text = f"Often x{new} y{new}, often. z{new}{more}"
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
        for known in (encoder.words, encoder.parts):
            assert len(known) + len(known.older) <= 30
    assert learned.count("often") == 1 and learned.count("Often") == bool(more)


def test_cases_and_signs_of_a_word_share_its_part():
    """A text of plain characters asks the model once per part, and remembers no words."""
    encoder = packing.WordEncoder(VOCABULARY)
    text = "Tree tree, TREE! (tree) tree. Größe GRÖSSE größe; it's"
    assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert not encoder.words and set(encoder.parts) == {"tree", ",", "!", "(", ")", ".", "größe", "grösse", ";", "it", "'s"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_best_two_fit_places_everything(lengths):
    sequence, offset = packing.best_two_fit(np.array(lengths, dtype=np.int64), 32)
    placed = defaultdict(list)
    for length, s, o in zip(lengths, sequence.tolist(), offset.tolist()):
        placed[s].append((o, length))
    for parts in placed.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 32
    assert len(placed) <= 2 * -(-sum(lengths) // 32)


def test_two_shorter_pieces_replace_the_last():
    # Greedy puts 5 and 3 into the first sequence of 10; 5 with 3 and 2 fills it.
    sequence, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    first = sequence[0]
    assert sorted(np.array([6, 3, 2, 2])[sequence == first].tolist()) == [2, 2, 6]
    assert len(set(sequence.tolist())) == 2


def check(rows, texts, size):
    """All ids of all texts, once, in gapless sequences."""
    want, got, filled = [], defaultdict(list), defaultdict(list)
    for doc, text in texts:
        all_ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(all_ids), size)):
            part = all_ids[start:start + size]
            want.append((doc, k, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size


def test_pack_odd_rows(spark):
    texts = [(1, None), (2, ""), (None, "a b"), (3, "word " * 5000), (4, "same text"), (4, "same text"), (5, "Größe — 12 ½")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in texts], "doc_id long, text string, piece int, length int")
    rows = packing.pack(docs, VOCABULARY, size=64, group_pieces=20).collect()
    check(rows, texts, 64)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


def test_documents_table(spark):
    from clearway.llm.queries import op9_best_fit_packing

    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = op9_best_fit_packing(spark, folder).collect()
    check(rows, texts, 2048)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) + 2
