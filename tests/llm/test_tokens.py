import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

from llm_helpers import ODD_TEXTS, frame, prose, with_rows  # noqa: E402
from logloom.llm import blocks, token_counts, token_files  # noqa: E402
from logloom.llm.encoder import Numbered, Pieces  # noqa: E402
from logloom.llm.text import importable  # noqa: E402
from logloom.session import scratch_path  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
SMALL = Pieces(PATH, memory=40)
SPANS = Pieces(PATH, memory=40, offsets=True)
NUMBERED = Numbered(PATH, memory=60)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sé,.1<|>  ", max_size=40), max_size=6))
def test_pieces_give_the_librarys_ids_and_offsets(texts):
    want = PLAIN.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in SMALL.encode(texts)] == [e.ids for e in want]
    assert [x.tolist() for x in NUMBERED.encode(texts)] == [e.ids for e in want]
    for got, e in zip(SPANS.encode(texts), want):
        assert [tuple(r) for r in got.tolist()] == [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([64, 128, 1024]), st.sampled_from([1.0, 50.0, 98.0, 100.0]))
def test_blocks_round_trip(ids, block, percentile):
    ids = np.array(ids, np.uint32)
    data = blocks.encode(ids, block, percentile)
    assert (blocks.decode(data) == ids).all() and len(blocks.decode(data)) == len(ids)
    for i in range(-(-len(ids) // block)):
        assert (blocks.read_block(data, i) == ids[i * block : (i + 1) * block]).all()


def test_numbered_pieces_give_the_librarys_ids_of_prose():
    texts = [*(prose(i, 300, 5000).replace(" w1", ", w1").replace("w2", "ß2.") for i in range(40)), "", prose(1, 20000, 9000)]
    own = Numbered(PATH)
    for _ in range(2):  # learned, then known
        assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in PLAIN.encode_batch(texts, add_special_tokens=False)]


def test_numbered_pieces_that_are_frequent_are_kept():
    own = Numbered(PATH, memory=100)
    common = [" ".join(f"w{i}" for i in range(20))] * 3
    rare = " ".join(f"x1y{i}" for i in range(90))
    own.encode([*common, rare])
    own.encode(["z"])  # over 100 pieces are known: the rare ones go
    assert "w7" in own.numbers and "x1y7" not in own.numbers
    texts = [*common, "w3 x1y8, x1y1", rare]
    for _ in range(4):
        assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in PLAIN.encode_batch(texts, add_special_tokens=False)]
        assert own.numbers.known == len(own.numbers) <= 50 + 120


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sé日🙂\u0301,.1<|>  ", max_size=40), max_size=6))
def test_spans_are_the_librarys_offsets(texts):
    texts = [*texts, *ODD_TEXTS, "a <|endoftext|> b"]
    texts = [t for t in texts if t is not None]
    for (first, after), e in zip(NUMBERED.spans(texts), PLAIN.encode_batch(texts, add_special_tokens=False)):
        assert list(zip(first.tolist(), after.tolist())) == e.offsets


def test_damaged_segment_is_refused():
    with pytest.raises(ValueError):
        blocks.decode(blocks.encode(np.arange(100, dtype=np.uint32))[:-1])


def test_files_hold_all_documents_in_order(spark):
    importable(spark)
    texts = [*ODD_TEXTS, *(prose(i, 50) for i in range(40))]
    df = with_rows(frame(spark, texts), (None, "no id"), (3, "another three"))
    root = scratch_path(spark, "test-tokens")
    token_files.write_tokens(df.repartition(5), root, PATH, segment_ids=200)
    rows = sorted(token_files.document_digests(spark, root).collect(), key=lambda r: r.start)
    docs = sorted([(-1, "no id"), (3, "another three"), *enumerate(texts)], key=lambda d: (d[0], d[1] or ""))
    at = 0
    assert [r.doc_id for r in rows] == [None if i < 0 else i for i, _ in docs]
    for r, (_, text) in zip(rows, docs):
        ids = [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    back = {r.doc_id: r.ids for r in token_files.read_ids(spark, root).where("doc_id = 10").collect()}
    assert back[10] == [*PLAIN.encode(texts[10], add_special_tokens=False).ids, 2]


def test_no_documents_no_segments(spark):
    importable(spark)
    root = scratch_path(spark, "test-no-tokens")
    token_files.write_tokens(frame(spark, ["a"]).where("doc_id < 0"), root, PATH)
    assert token_files.document_digests(spark, root).collect() == []


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_against_a_loop(spark, rule):
    importable(spark)

    def tens(text):
        return np.array([*range(7, len(text), 7), len(text)])

    texts = [*ODD_TEXTS, prose(1, 60), "ééé " * 20]
    got = {}
    for r in token_counts.section_tokens(frame(spark, texts), PATH, rule, tens).collect():
        got[r.doc_id, r.section] = (r.n_tokens, r.n_crossing)
    for d, text in enumerate(texts):
        bounds = tens(text or "").tolist()
        want = {s: [0, 0] for s in range(len(bounds))}
        for a, b in PLAIN.encode(text or "", add_special_tokens=False).offsets:
            home = [next((s for s, e in enumerate(bounds) if c < e), len(bounds) - 1) for c in range(a, max(b, a + 1))]
            to = {"first": home[0], "last": home[-1], "majority": max(sorted(set(home)), key=home.count)}[rule]
            want[to][0] += 1
            want[to][1] += len(set(home)) > 1
        assert {s: tuple(v) for s, v in want.items()} == {s: v for (i, s), v in got.items() if i == d}, (d, text)


def test_lines_as_sections(spark):
    importable(spark)
    rows = token_counts.section_tokens(frame(spark, ["a b\nc", None, "x\n"]), PATH).orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.section, r.char_start, r.char_end) for r in rows] == [(0, 0, 0, 4), (0, 1, 4, 5), (1, 0, 0, 0), (2, 0, 0, 2)]


def test_words_are_looked_up_once_in_a_batch():
    own = Numbered(PATH)
    own.numbers.met.clear()
    asked = []

    class Asked(type(own.numbers)):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    own.numbers.__class__ = Asked
    texts = [prose(i, 300, 50) for i in range(30)]
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in PLAIN.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) <= 50 + 30


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(categories=["L"]), min_size=1, max_size=12), min_size=1, max_size=40))
def test_pieces_of_letters_have_the_librarys_ids(words):
    text = " ".join([*words, *(w + "." for w in words), *(c + chr(b) for c, b in zip("abc", (0xAA, 0xB5, 0x24F)))])
    assert NUMBERED.encode([text])[0].tolist() == PLAIN.encode(text, add_special_tokens=False).ids
