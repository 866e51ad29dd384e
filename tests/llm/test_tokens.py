import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factweave.llm import packing as P
from factweave.llm import sentencepiece_fst as S

TEXT = st.lists(st.sampled_from(list("ab ▁\n\tthe日本é😀=-0١<|>ß") + ["  ", "ing", "\x00", "<|endoftext|>"]), max_size=40).map("".join)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(TEXT | st.text(max_size=30))
def test_shortest_path_is_the_librarys_encoding(text):
    ids = S.transducer().encode(text)
    assert ids.tolist() == LIBRARY.encode(text)
    assert S.transducer().decode(ids) == LIBRARY.decode(ids.tolist()) == text.replace("▁", " ")


@pytest.mark.parametrize("text", ["a" * 3000, " " * 3000, "=-" * 2000, "日本語" * 500])
def test_long_parts(text):
    assert S.transducer().encode(text).tolist() == LIBRARY.encode(text)


def message(*fields):
    """Bytes of a protocol-buffer message from (number, value) pairs."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


UNIGRAM = {"▁": -2.0, "▁a": -1.5, "a": -2.5, "b": -3.0, "ab": -3.25, "▁ab": -4.0, "ba": -3.0, "bab": -4.75, "é": -5.0, "aa": -4.5, "▁b": -2.75}


def unigram_model(prefix=1, collapse=1, with_bytes=True, pieces=UNIGRAM):
    """A small hand-made unigram model, as the library's file format has it."""
    own = [(1, message((1, b"<unk>"), (2, 0.0), (3, 2))), (1, message((1, b"<s>"), (2, 0.0), (3, 3))), (1, message((1, b"</s>"), (2, 0.0), (3, 3)))]
    own += [(1, message((1, f"<0x{i:02X}>".encode()), (2, 0.0), (3, 6))) for i in range(256) if with_bytes]
    own += [(1, message((1, t.encode()), (2, v))) for t, v in pieces.items()]
    return message(*own, (2, message((3, 1), (35, int(with_bytes)))), (3, message((1, b"identity"), (3, prefix), (4, collapse))))


@pytest.mark.parametrize("options", [{}, {"collapse": 0}, {"prefix": 0}, {"prefix": 0, "collapse": 0}, {"with_bytes": False}])
def test_unigram_models_and_normalisers_as_the_library(options):
    model = unigram_model(**options)
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=model), S.Transducer(model)

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet="ab  é日c\n", max_size=16))
    def compare(text):
        assert machine.encode(text).tolist() == library.encode(text), text

    compare()


def segmentations(text, machine):
    """Every path of the lattice with its weight, by brute force."""
    if not text:
        yield 0.0, ()
        return
    for size in range(1, len(text) + 1):
        head = text[:size]
        if head in machine.score:
            weight = -machine.score[head]
        elif size == 1:
            weight = machine.lacking
        else:
            continue
        for rest, path in segmentations(text[size:], machine):
            yield weight + rest, (head, *path)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab▁éx", min_size=1, max_size=9))
def test_shortest_path_against_all_paths(text):
    machine = S.Transducer(unigram_model())
    at, weight = 0, 0.0
    for end, piece in zip(*machine.shortest_path(text), strict=True):
        weight += -machine.score[text[at:end]] if piece >= 0 else machine.lacking
        at = end
    assert at == len(text) and weight == min(w for w, _ in segmentations(text, machine))


def test_cache_limits(monkeypatch):
    machine = S.Transducer(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    monkeypatch.setattr(S, "REMEMBERED", 2)
    assert machine.encode("one two three four one").tolist() == LIBRARY.encode("one two three four one")
    assert all(len(k) <= 2 for k in machine.known) and len(machine.follows) <= 2


def test_encode_odd_rows(docs_of, odd_rows):
    out = S.encode(docs_of(odd_rows))
    rows = out.collect()
    assert len(rows) == len(odd_rows) and "text" not in out.columns
    by = {r.doc_id: r for r in rows}
    assert bytes(by[1].ids) == bytes(by[2].ids) == b"" and by[1].decoded == ""
    assert by[8].decoded == "long " * 40_000 and by[7].decoded == odd_rows[6][1].replace("▁", " ")
    assert S.encode(docs_of([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(TEXT | st.text(max_size=30))
def test_ids_are_those_of_the_named_library(text):
    assert P.encoder()(text) == REFERENCE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>a", "<|endoftext", "é<|endoftext|>\n"])
def test_added_tokens_have_their_own_ids(text, docs_of):
    want = REFERENCE.encode(text, add_special_tokens=False).ids
    assert P.encoder()(text) == want and (50256 in want) == ("<|endoftext|>" in text)
    check([tuple(r) for r in P.pack(docs_of([(1, text)])).collect()], {1: np.array([*want, 0])})


def test_long_documents_travel_in_parts(docs_of, monkeypatch):
    texts = {1: "one two three " * 300, 2: "", 3: "four " * 90}
    monkeypatch.setattr(P, "PART", 64)
    parts = P.tokenise(docs_of(texts.items())).collect()
    assert max(len(r.ids) for r in parts) == 128 and len(parts) > 10
    check([tuple(r) for r in P.pack(docs_of(texts.items())).collect()], {i: np.array([*REFERENCE.encode(t, add_special_tokens=False).ids, 0]) for i, t in texts.items()})


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = P.hilbert(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@given(st.lists(st.integers(1, 3000), max_size=12))
def test_streams_are_cut_without_gap_or_padding(sizes):
    docs = [(i, np.arange(n, dtype=np.uint16)) for i, n in enumerate(sizes)]
    check(list(P.pack_stream(((i, 0, len(x), x) for i, x in docs), 5)), dict(docs))


def check(pieces, ids):
    sequences, documents = {}, {}
    for doc, start, length, crc, total, sequence, offset in pieces:
        sequences.setdefault(sequence, []).append((offset, length))
        documents.setdefault(doc, []).append((start, length))
        assert total == len(ids[doc]) and crc == zlib.crc32(ids[doc][start : start + length].astype("<u4").tobytes())
    for parts in [*sequences.values(), *documents.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    for parts in sequences.values():
        n = sum(length for _, length in parts)
        assert n <= 1024 and n & (n - 1) == 0
    assert {d: sum(x[1] for x in p) for d, p in documents.items()} == {d: len(x) for d, x in ids.items() if len(x)}


def test_pack_odd_rows(docs_of, odd_rows, spark):
    rows = list({r[0]: r for r in odd_rows if r[0] is not None}.values())
    pieces = [tuple(r) for r in P.pack(docs_of(rows)).collect()]
    check(pieces, {i: np.array([*REFERENCE.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows})
    assert P.pack(docs_of([])).count() == 0
    assert P.pack(docs_of([(None, "x"), (1, "x"), (1, "x")])).count() == 3
