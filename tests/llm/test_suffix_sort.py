"""Shards of the string index with texts that hold the byte of the mark."""
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tidewire.llm import suffix_sort


def test_a_run_across_a_mark_is_no_window():
    symbols = [b"a" * 50 + b"\0" * 50, b"\0" * 100, b"\0" * 101]
    rows = pa.table({"anchor": pa.array([1, 1, 1]), "stretch": pa.array([1, 2, 3]), "doc_id": pa.array([1, 2, 3]),
                     "start": pa.array([0, 0, 7]), "n": pa.array([len(s) - 99 for s in symbols], pa.int32()),
                     "symbols": pa.array(symbols, pa.binary()), "deals": pa.array([[0]] * 3, pa.list_(pa.int32()))})
    got = suffix_sort._search(rows, 100).to_pylist()
    first = {(r["stretch"], i): (r["first_doc"], r["first_start"] + i - r["at"])
             for r in got for i in range(r["at"], r["until"])}
    assert first[1, 0] == (1, 0) and first[2, 0] == (2, 0)
    assert {first[3, i][0] for i in (0, 1)} == {2}


def made(symbols: list[bytes]) -> pa.Table:
    k = len(symbols)
    return pa.table({"anchor": pa.array([1] * k), "stretch": pa.array(range(k)), "doc_id": pa.array(range(k)),
                     "start": pa.array([0] * k), "n": pa.array([len(s) - 99 for s in symbols], pa.int32()),
                     "symbols": pa.array(symbols, pa.binary()), "deals": pa.array([[0]] * k, pa.list_(pa.int32()))})


def texts(k: int, seed: int) -> list[bytes]:
    rng = random.Random(seed)
    parts = [bytes(rng.choices(b"abcd \0", k=rng.randint(1, 90))) for _ in range(40)]
    return [b"".join(rng.choices(parts, k=9))[:rng.randint(100, 180)].ljust(100, b"a") for _ in range(k)]


def test_first_places_equal_brute_force():
    symbols = texts(400, 2) + [b"a" * 170, b"ab" * 90, b"a" * 150, b"ab" * 60]
    first = {}
    for row, s in enumerate(symbols):
        for i in range(len(s) - 99):
            first.setdefault(s[i:i + 100], (row, i))
    got = {(r["stretch"], i): (r["first_doc"], r["first_start"] + i - r["at"])
           for r in suffix_sort._search(made(symbols), 100).to_pylist() for i in range(r["at"], r["until"])}
    assert got == {(row, i): first[s[i:i + 100]] for row, s in enumerate(symbols) for i in range(len(s) - 99)}


def test_a_search_holds_little_memory():
    rows = made(texts(4000, 3))
    suffix_sort._search(made(texts(10, 3)), 100)
    tracemalloc.start()
    suffix_sort._search(rows, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 62 * rows.column("symbols").nbytes


def test_shards_stay_near_their_limit(monkeypatch):
    sizes = []
    monkeypatch.setattr(suffix_sort, "SHARD_BYTES", 20000)
    monkeypatch.setattr(suffix_sort, "_search", lambda rows, width: sizes.append(rows.column("symbols").nbytes))
    rows = made(texts(2000, 4)).set_column(0, "anchor", pa.array(np.arange(2000) // 3))
    list(suffix_sort._index(100)(rows.to_batches()))
    assert len(sizes) > 5 and max(sizes) < 25000
