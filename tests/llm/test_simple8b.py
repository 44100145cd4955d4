import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tripweave.llm import simple8b


@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50000), st.integers(0, 2**64 - 1)), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_any_numbers_come_back(values):
    packed = simple8b.from_bytes(simple8b.to_bytes(simple8b.pack(np.array(values, np.uint64))))
    assert simple8b.unpack(packed).tolist() == values


@pytest.mark.parametrize("width", range(65))
def test_every_width_over_several_blocks(width):
    values = np.full(3 * simple8b.BLOCK + 5, (1 << width) - 1, np.uint64)
    packed = simple8b.pack(values)
    assert (simple8b.unpack(packed) == values).all()
    assert (len(packed.escapes) > 0) == (width > 60)
    if 0 < width <= 60:
        assert len(packed.words) <= 3 * (-(-simple8b.BLOCK // (60 // width)) ) + 5


def test_blocks_are_read_alone_by_their_offsets():
    values = np.random.default_rng(1).integers(0, 2**20, 5000).astype(np.uint64)
    values[::700] = 2**63 + 5
    packed = simple8b.pack(values)
    for block in range(len(packed.offsets)):
        part = values[block * simple8b.BLOCK:(block + 1) * simple8b.BLOCK]
        assert (simple8b.unpack_block(packed, block) == part).all()


def test_damage_is_noticed():
    data = bytearray(simple8b.to_bytes(simple8b.pack(np.arange(100, dtype=np.uint64))))
    data[30] ^= 1
    with pytest.raises(ValueError):
        simple8b.from_bytes(bytes(data))
