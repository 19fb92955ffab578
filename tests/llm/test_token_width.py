"""Widths of token ids: taken from the tokenizer, and never too narrow without an error."""

import json
import zlib

import numpy as np
import pytest
from hyperplane.llm import token_files
from hyperplane.llm.token_files import id_bits, pack, read_tokens, unpack, write_tokens


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """A vocabulary of 70,000 words, of which the last are beyond 16 bits."""
    path = tmp_path_factory.mktemp("vocabulary") / "wide.json"
    model = {"type": "WordLevel", "vocab": {f"w{k}": k for k in range(70_000)}, "unk_token": "w1"}
    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": model}))
    return str(path)


def test_ids_that_do_not_fit(wide):
    assert id_bits(wide, 0) == 17 and id_bits(wide, 1 << 20) == 21
    for bits in (1, 7, 16, 17, 32):
        most = np.array([0, (1 << bits) - 1, 1], np.uint32)
        assert unpack(pack(most, bits), bits, 3).tolist() == most.tolist()
        if bits < 32:
            with pytest.raises(ValueError):
                pack(np.array([1 << bits]), bits)


def test_a_vocabulary_beyond_16_bits(spark, wide, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 7)
    rows = [(k, " ".join(f"w{j}" for j in range(69_990 - k, 70_000 - k))) for k in range(30)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_tokens(write_tokens(docs, wide)).collect()}
    for k in range(30):
        ids = np.array([*range(69_990 - k, 70_000 - k), 0], "<u4")
        assert got[k] == (11 * k, 11, zlib.crc32(ids.tobytes()))
    assert got[99] == (330, 1, zlib.crc32(np.zeros(1, "<u4").tobytes()))
    with pytest.raises(Exception, match="does not fit"):
        write_tokens(docs, wide, vocabulary=50_257).count()
