"""What a worker keeps belongs to one operator at a time."""

import random
import sys
import weakref

import public_tokenizers
import pyarrow as pa

from loomarc.llm import bytetext, token_files


def test_an_encoder_goes_when_other_operators_begin():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    held = weakref.ref(token_files.encoder(path))
    assert token_files.encoder(path) is held()
    assert [s[:2] for s in bytetext.slices(pa.array(["some words"]))] == [(0, 1)]
    assert held() is None
    assert len(token_files.encoder(path).encode(["some words"])[0]) > 0


def test_what_an_encoder_keeps_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(token_files.Encoder, "KEPT", 200_000)
    enc, draw = token_files.Encoder(str(public_tokenizers.path("byte_bpe_50k.json"))), random.Random(5)
    for _ in range(40):
        texts = [" ".join(f"{draw.getrandbits(2000):x}" for _ in range(5)) + " the same words." for _ in range(20)]
        whole = enc.library.encode_batch(texts, add_special_tokens=False)
        assert [ids.tolist() for ids in enc.encode(texts)] == [w.ids for w in whole]
        tables = (enc.kept, enc.kept.before)
        held = sum(sys.getsizeof(x) for table in tables for item in table.items() for x in item)
        assert held < 2 * (200_000 + 400_000)  # a batch of these takes less than 400,000
    assert not getattr(enc.kept.before, "before", None)


def test_texts_encoded_together_are_few_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "TEXT_BYTES", 100)
    texts = ["a" * 60, "b" * 60, None, "c" * 300, "", "d", "e" * 99]
    for rows in (texts, texts[::-1], [], [None], ["x"] * 600):
        parts = list(token_files._parts(pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string())})))
        assert [t for p in parts for t in p.column("text").to_pylist()] == rows
        assert all(0 < p.num_rows <= 256 and (p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 100) for p in parts)
