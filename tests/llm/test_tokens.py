import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from graphmill.llm.tokens import PieceEncoder, SequenceReader, SequenceWriter, read_documents, write_token_files

BPE = P.path("byte_bpe_50k.json")


def plain(texts):
    t = Tokenizer.from_file(BPE)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def odd_texts():
    r = random.Random(3)
    parts = ["word", " ", "\n", "  ", " \n", "\t", "'s", "é", "12", ".", ",", "\0", " a", "<|endoftext|>", "\r\n", "　", "\x1c", "漢字"]
    return ["", " ", "\n", "a", " a", "a ", "a\nb", "a \n b"] + ["".join(r.choices(parts, k=r.randint(1, 30))) for _ in range(600)]


@pytest.mark.parametrize("most", [500_000, 20])
def test_piece_encoder_equals_plain(most):
    texts = odd_texts()
    code = PieceEncoder(BPE, most)
    want = plain(texts)
    for at in range(0, len(texts), 100):
        assert [x.tolist() for x in code.encode(texts[at : at + 100])] == want[at : at + 100]


WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]


@pytest.mark.parametrize("size,most", [(7, 5), (5000, 500_000)])
def test_any_white_space_at_the_start(size, most):
    r = random.Random(4)
    texts = ["".join(x) + r.choice(["a", "word b", "", ".x"]) for n in (1, 2, 3) for x in itertools.product(WHITE, repeat=n)] + ["q"] * 50
    r.shuffle(texts)
    code, want = PieceEncoder(BPE, most), [e.ids for e in Tokenizer.from_file(BPE).encode_batch_fast(texts, add_special_tokens=False)]
    for at in range(0, len(texts), size):
        assert [x.tolist() for x in code.encode(texts[at : at + size])] == want[at : at + size]


def test_random_unicode():
    r = random.Random(5)
    letters = [*WHITE, *"ab c'.,1 \n\t", "é", "ß", "中", "\u0301", "\u200b", "'s", "\0", "𝒳", *["\u00a0"] * 3, "the", "ing"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 14))) for _ in range(100_000)]
    code, want = PieceEncoder(BPE, 1000), [e.ids for e in Tokenizer.from_file(BPE).encode_batch_fast(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 512):
        assert [x.tolist() for x in code.encode(texts[at : at + 512])] == want[at : at + 512]


def test_other_tokenizers_go_whole():
    code = PieceEncoder(P.path("word_bpe_49k.json"))
    assert not code.by_piece and len(code.encode(["a b"])[0])


@pytest.mark.parametrize("n", [0, 1, 7, 8, 63, 64, 65, 1000])
def test_file_round_trip(tmp_path, n):
    ids = np.arange(n, dtype=np.uint16)
    path = str(tmp_path / "x.arrows")
    with open(path, "wb") as f:
        w = SequenceWriter(f, np.uint16, length=8, rows=4)
        for part in np.array_split(ids, 5):
            w.add(part)
        assert w.close() == n
    r = SequenceReader(path)
    for start, count in [(0, n), (n // 2, n - n // 2), (n // 3, min(9, n - n // 3))]:
        assert r.ids(start, count).tolist() == ids[start : start + count].tolist()
    if n:
        got, mask = r.sequence((n - 1) // 8)
        assert got[(n - 1) % 8] == n - 1 and sum(mask.to_pylist()) == (n - 1) % 8 + 1


def test_documents_round_trip(spark):
    texts = odd_texts()[:200] + [None, "long " * 50000]
    rows = [(k * 3, t, "clash") for k, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    got = {r.doc_id: r for r in read_documents(write_token_files(spark.createDataFrame(rows, "doc_id long, text string, path string"), BPE, 2)).collect()}
    at = 0
    for doc_id, text, _ in sorted(rows):
        ids = plain([text or ""])[0] + [2]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_special_strings_become_their_token():
    assert [x.tolist() for x in PieceEncoder(BPE).encode(["a <|endoftext|> b", "a b"])] == plain(["a <|endoftext|> b", "a b"]) and 50256 in plain(["a <|endoftext|> b"])[0]


def test_repeated_and_null_ids(spark):
    rows = [(5, "b b"), (5, "a"), (None, "n"), (5, "a"), (None, None), (1, "<|endoftext|>")]
    got = read_documents(write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), BPE, 2)).collect()
    order = [(None, ""), (None, "n"), (1, "<|endoftext|>"), (5, "a"), (5, "a"), (5, "b b")]
    want, at = [], 0
    for doc_id, text in order:
        ids = plain([text])[0] + [2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_no_documents(spark):
    assert read_documents(write_token_files(spark.createDataFrame([], "doc_id long, text string"), BPE, 2)).collect() == []
