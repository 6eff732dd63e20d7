import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from brightfield.llm import token_files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_come_back(values):
    values = np.array(values, np.uint32)
    body, starts = token_files.encode_blocks(values)
    assert (token_files.decode_blocks(np.frombuffer(body, np.uint8), starts, len(values)) == values).all()


def test_file_and_single_block():
    rng = np.random.default_rng(1)
    docs = [(k or None, rng.integers(0, 50_000, n).astype("<u4").tobytes()) for k, n in enumerate([0, 1, 500, 128, 3])]
    payload = token_files.write_file(docs)
    table, no_id, values = token_files.read_file(payload)
    assert table.tolist() == [[k or 0, len(i) // 4] for k, i in docs] and no_id.tolist() == [True] + [False] * 4
    assert values.tobytes() == b"".join(i for _, i in docs)
    assert (token_files.read_block(payload, 2) == values[256:384]).all()
    assert len(token_files.read_block(payload, 4)) == 632 - 512
