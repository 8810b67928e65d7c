"""Hashes of words take memory by the stretch, not eight bytes and more for each byte of the texts,
and workers return what they have freed."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import jaccard_join, shingles


def by_hand(word: bytes) -> int:
    base, out = int(shingles.BASE), 0
    for i, byte in enumerate(word):
        out += int(shingles.BYTE_CODES[byte]) * pow(base, i, 1 << 64)
    return int(shingles.mixed(np.array([out % (1 << 64) ^ len(word)], np.uint64))[0])


@pytest.mark.parametrize("long", [1, shingles.STRETCH - 1, shingles.STRETCH, 3 * shingles.STRETCH])
def test_hashes_do_not_depend_on_stretches(long):
    words = ["ab", "x" * long, "c", *(f"w{i}" for i in range(40000)), "y" * long, "ab"]
    low, starts, stops, _ = shingles.words_of(pa.array([" ".join(words), "", "ab"]))
    got = shingles.hashes_of(low, starts, stops)
    assert len(got) == len(words) + 1 and got[0] == got[-1] == got[-2]
    for i in (0, 1, 2, 3, 20000, len(words) - 2):
        assert int(got[i]) == by_hand(words[i].encode())


def test_a_slice_of_texts_takes_little_beside_its_sets():
    text = " ".join(f"word{i % 977}of{i % 1013}" for i in range(250))
    part = pa.record_batch([pa.array(range(2000)), pa.array([text] * 2000)], names=["id", "text"])
    size = 2000 * len(text)
    assert size < jaccard_join.SLICE
    tracemalloc.start()
    rows = sum(b.num_rows for b in jaccard_join._sets(5)(iter([part])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2001 and peak < 20 * size


LEFT = """
import re
import pyarrow as pa
from fleetlens.llm import jaccard_join

def own():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    for at in range(4):
        texts = [" ".join(f"w{(at * 7 + i * j) % 4999}" for j in range(400)) for i in range(3000)]
        yield pa.record_batch([pa.array(range(3000)), pa.array(texts)], names=["id", "text"])

run = jaccard_join._sets(5)
before = own()
assert sum(b.num_rows for b in run(batches())) >= 12000
print(own() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs the kernel's own figures")
def test_an_idle_worker_keeps_little_of_its_last_task():
    root = Path(__file__).parents[2]
    done = subprocess.run([sys.executable, "-c", LEFT], cwd=root, capture_output=True, text=True, timeout=120, check=True)
    assert float(done.stdout) < 50
