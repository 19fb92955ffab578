"""Units without spaces of any length: cut where no piece crosses, with the same segmentations and shares as in one."""

import base64
import random
import time

import numpy as np
import pytest
from hyperplane.llm import piece_lattice, registry

VOC = piece_lattice.vocabulary(f"{registry.TOKENIZERS}/piece_bpe_32k.model")


def texts():
    rng = random.Random(4)
    yield base64.b64encode(rng.randbytes(900))
    yield "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400)).encode()
    yield b"function(a,b){return a.c+b[0]};" * 30
    yield "".join(rng.choice("abcdeéß€日🙂xyzÄ") for _ in range(900)).encode()
    yield b"x" * 900


@pytest.mark.parametrize("stretch", [1 << 18, 64])
def test_parts_have_the_shares_of_the_whole(monkeypatch, stretch):
    """The sums of all segmentations multiply to that of the unit in one, and no part's piece is missed at a border between stretches."""
    monkeypatch.setattr(piece_lattice, "CUT_BYTES", stretch)
    for text in texts():
        unit = piece_lattice.units_of(text)[0]
        parts = VOC.cut(unit)
        assert b"".join(parts) == unit and all(p.decode() for p in parts)
        whole = piece_lattice.Lattice(VOC, [unit])
        apart = piece_lattice.Lattice(VOC, parts)
        assert apart.beta[apart.start].sum() == pytest.approx(whole.beta[0], rel=1e-12)
    assert len(VOC.cut(piece_lattice.units_of(next(texts()))[0])) > 10


def test_samples_of_long_units(monkeypatch):
    for text in texts():
        found = piece_lattice.sample(VOC, [text, b"a b", text], np.array([3, 4, 3]), 3)
        assert found[0][0][0].tolist() == found[2][0][0].tolist()
        assert len({tuple(ids.tolist()) for ids, *_ in found[0]}) == len(found[0])
        assert all(VOC.decode(ids) == text for ids, *_ in found[0])
    # Others are sampled as before.
    alone = piece_lattice.sample(VOC, [b"a b"], np.array([4]), 3)
    assert [x[0].tolist() for x in alone[0]] == [x[0].tolist() for x in found[1]]


def test_a_megabyte_without_a_space():
    text = base64.b64encode(random.Random(1).randbytes(750_000))
    began = time.process_time()
    found = piece_lattice.sample(VOC, [text], np.array([5]), 2)
    assert time.process_time() - began < 20 and VOC.decode(found[0][1][0]) == text
