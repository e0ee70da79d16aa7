import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from textquarry.llm import bpe


@pytest.fixture(scope="module")
def peer():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    alphabet = ["a", "B", "7", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "漢", "字", "🙂", " ", "　", "́", "\x00", "<|endoftext|>", "!!", "_", "​", "٣"]
    made = ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(300)]
    wide = ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F600)])) for _ in range(60)) for _ in range(50)]
    long = " ".join(rng.choices(made, k=3000))
    return [*made, *wide, long, "", None, "x" * 5000, " " * 3000, "ab " * 1000]


def test_against_peer_and_round_trip(spark, peer, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 1000)
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    rows = bpe.encode(df, tuple(bpe.OUTPUTS)).orderBy("id").collect()
    for text, row in zip(given, rows):
        text = text or ""
        want = peer.encode_ordinary(text)
        assert row.ids == want and row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert bytes(row.decoded) == text.encode() and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        data = [peer.decode_single_token_bytes(i) for i in want]
        if len(text) > 500:
            assert row.starts[0] == 0 and row.ends[-1] == len(text)
            continue
        at = 0
        for piece, a, b in zip(data, row.starts, row.ends):
            assert len(text.encode()[:at].decode(errors="ignore")) == a
            at += len(piece)
            assert len(text.encode()[:at].decode(errors="replace")) == b or len(text.encode()[:at].decode(errors="ignore")) + 1 == b
    back = bpe.decode(bpe.encode(df, ("ids",))).orderBy("id").collect()
    assert [r.text for r in back] == [t or "" for t in given]


def test_split_characters_decode_to_null_text(spark):
    ids = bpe.encode(spark.createDataFrame([(1, "🙂")], "doc_id long, text string"), ("ids",)).first().ids
    assert len(ids) > 1
    back = bpe.decode(spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None)], "id long, ids array<int>")).orderBy("id").collect()
    assert [r.text for r in back] == ["🙂", None, None]
    assert bytes(back[1].decoded) == "🙂".encode()[: len(back[1].decoded)]


def test_odd_rows(odd, clashing, none, peer):
    assert bpe.encode(none).collect() == []
    want = sorted((str(r.doc_id), peer.encode_ordinary(r.text or "")) for r in odd.collect())
    for df in (odd, clashing):
        assert sorted((str(r.id), r.ids) for r in bpe.encode(df, ("ids",)).collect()) == want
