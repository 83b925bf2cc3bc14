import random

import numpy as np
import pytest
from loomtab.llm import induced as I


def _brute(text):
    b = bytes(text)
    order = sorted(range(len(b)), key=lambda i: b[i:])
    common = [0]
    for x, y in zip(order, order[1:]):
        k = 0
        while max(x, y) + k < len(b) and b[x + k] == b[y + k]:
            k += 1
        common.append(min(k, I.CAP))
    return order, common


@pytest.mark.parametrize("memory", [40, 1 << 20])
@pytest.mark.parametrize("base", [2, 1 << 20])
def test_suffix_and_common_prefix_arrays(memory, base):
    r = random.Random(memory + base)
    for _ in range(150):
        top = r.choice([2, 3, 5, 30])
        text = [r.randrange(0 if r.random() < 0.3 else 1, top) for _ in range(r.randrange(1, 70))] + [1, 0]
        if r.random() < 0.3:
            text = text[:-1] * 3 + [0]
        order, common = I.suffix_array(np.array(text, np.uint8), top + 1, memory, base)
        assert (order.tolist(), common.tolist()) == _brute(text)


def test_long_runs():
    text = [97] * 600 + [98] + [97] * 300 + [0]
    order, common = I.suffix_array(np.array(text, np.uint8), 256, memory=1000)
    assert (order.tolist(), common.tolist()) == _brute(text)


def test_order_to_a_depth():
    r = random.Random(9)
    part = [r.randrange(1, 4) for _ in range(60)]
    text = bytes(part * 4 + [r.randrange(1, 4) for _ in range(80)] + part * 2 + [0])
    order, common = I.suffix_array(np.frombuffer(text, np.uint8), 4, depth=16)
    cut = [text[i : i + 16] for i in order]
    assert cut == sorted(cut)
    for a, b, c in zip(order, order[1:], common[1:]):
        assert (text[a : a + 16] == text[b : b + 16] and len(text) - max(a, b) >= 16) == (c >= 16)


def test_no_files_stay(tmp_path, monkeypatch):
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    import tempfile

    monkeypatch.setattr(tempfile, "tempdir", None)
    text = np.array([1 + i * 7 % 11 for i in range(5000)] + [0], np.uint8)
    I.suffix_array(text, 13, memory=100, base=50)
    assert list(tmp_path.iterdir()) == []
