import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lendlens.llm import piece_viterbi as pv
from tests.llm.fixtures import awkward_docs, empty_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")


def full_lattice(m, s):
    """Viterbi over the whole text at once."""
    n = len(s)
    best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + m.longest) + 1):
            found = m.trie.get(s[i:j])
            if found and best[i] + found[0] > best[j]:
                best[j], back[j] = best[i] + found[0], (i, found[1])
        if not m.trie.get(s[i]) and best[i] + m.unknown > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + m.unknown, (i, -1)
    out = []
    while n:
        i, p = back[n]
        out += m._bytes(s[i])[::-1] if p < 0 else [p]
        n = i
    return out[::-1]


@given(st.text(alphabet="abcet hn\n▁éß日.,12\x00", max_size=200), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_streaming_equals_the_full_lattice(text, size):
    m = pv.model(PATH)
    marked = pv.BLANK + text.replace(" ", pv.BLANK)
    want = full_lattice(m, marked)
    assert [i for ids in m.stream(marked[p:p + size] for p in range(0, len(marked), size)) for i in ids] == want
    if text:
        assert m.encode(text).tolist() == want
    assert m.decode(m.encode(text).tolist()) == text.replace(pv.BLANK, " ")


@given(st.lists(st.none() | st.text(alphabet="abcet hn\n▁éß日.,12\x00", max_size=120), max_size=12))
@settings(max_examples=60, deadline=None)
def test_texts_together_equal_texts_alone(texts):
    m = pv.model(PATH)
    m.known = pv.Memory(40)
    want = [full_lattice(m, pv.BLANK + t.replace(" ", pv.BLANK)) if t else [] for t in texts]
    assert [x.tolist() for x in m.encode_all(texts)] == want


def test_words_that_begin_alike_are_searched_from_where_they_part():
    """New words of all texts of a group are searched in order, and look up far fewer stretches than each by itself."""
    m, asked = pv.PieceModel(PATH), 0

    class Counted(dict):
        def get(self, key, other=None):
            nonlocal asked
            asked += 1
            return dict.get(self, key, other)

    m.ends = Counted(m.ends)
    m.trie = Counted(m.trie)
    texts = [f"internationalization{i} misunderstandings{i}" for i in range(300)] + ["x" * (pv.CHUNK + 5), None, "é" * 70 + " end"]
    got = [x.tolist() for x in m.encode_all(texts[:300])]
    assert asked < 20_000, asked
    assert got + [x.tolist() for x in m.encode_all(texts[300:])] == [m.encode(t).tolist() for t in texts]


@pytest.mark.parametrize("text", ["a" * 5000, "abab" * 2000, "the" * 3000, "日" * 900])
def test_long_stretches_without_a_boundary(text):
    m = pv.model(PATH)
    assert m.encode(text).tolist() == full_lattice(m, pv.BLANK + text)
    held = list(m.stream([pv.BLANK + text]))
    assert [i for ids in held for i in ids] == m.encode(text).tolist()


@pytest.mark.parametrize("text", [" " * 5000 + "the end", "word " * 3000, "a" * 200 + " " * 300 + "b" * 500 + "\n" + "c" * 70, "\n" * 400])
@pytest.mark.parametrize("size", [1, 7, 4096])
def test_chunks_of_any_size(text, size):
    m = pv.model(PATH)
    marked = pv.BLANK + text.replace(" ", pv.BLANK)
    assert [int(i) for ids in m.stream(marked[p:p + size] for p in range(0, len(marked), size)) for i in ids] == full_lattice(m, marked)


def test_the_window_of_a_whole_document_is_bounded():
    """Ids leave as the text arrives, and what is held stays small, for ordinary text and for a word without an end."""
    m = pv.model(PATH)
    for text in ("the house of the rising sun " * 4000, "abcab" * 20000):
        marked = pv.BLANK + text.replace(" ", pv.BLANK)
        sent, got, most = 0, 0, 0

        def chunks():
            nonlocal sent
            for p in range(0, len(marked), 100):
                sent = p + 100
                yield marked[p:p + 100]

        for ids in m.stream(chunks()):
            got += len(m.decode(ids).replace(" ", pv.BLANK))
            most = max(most, sent - got)
        assert most < 2000 + 100, most


def test_awkward_documents(spark):
    docs = awkward_docs(spark)
    m = pv.model(PATH)
    want = sorted((str(r.doc_id), m.encode(r.text).tolist()) for r in docs.collect())
    coded = pv.encode_texts(docs, PATH)
    assert sorted((str(r.id), r.ids) for r in coded.collect()) == want
    back = sorted((str(r.id), r.text) for r in pv.decode_ids(coded, PATH).collect())
    assert back == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sorted((str(r.id), r.ids, r.decoded) for r in pv.round_trip(docs, PATH).collect()) == [(i, ids, t) for (i, ids), (_, t) in zip(want, back)]
    assert pv.encode_texts(empty_docs(spark), PATH).collect() == []
    null = spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>")
    assert {r.id: r.text for r in pv.decode_ids(null, PATH).collect()} == {1: None, 2: ""}
