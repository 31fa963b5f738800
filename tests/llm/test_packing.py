import struct
import zlib

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from twinsift.llm import packing, tokens




@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBcst'xyz \t\n\x1c\x85\xa0é É²ßŒ12_-.日Σ́İǅ<|>"), max_size=30))
def test_ids_are_the_tokenizers(text):
    encoder = _ENCODER
    ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


_ENCODER = tokens.ChunkedEncoder(most=50)


def test_every_entry_is_what_its_symbols_merge_to():
    """With this, merging by the rank of the merged entry is merging by the vocabulary's list."""
    import json

    with open(tokens.located(tokens.DEFAULT_VOCABULARY), encoding="utf-8") as file:
        model = json.load(file)["model"]
    ranks = {tuple(pair if isinstance(pair, list) else pair.split(" ")): n for n, pair in enumerate(model["merges"])}
    for entry in model["vocab"]:
        ends = entry.endswith("</w>") and entry != "</w>"
        symbols = list(entry.removesuffix("</w>") if ends else entry)
        if ends:
            symbols[-1] += "</w>"
        while len(symbols) > 1:
            found = [(ranks.get(pair, 1 << 30), at) for at, pair in enumerate(zip(symbols, symbols[1:]))]
            rank, at = min(found)
            if rank == 1 << 30:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        assert symbols == [entry]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_is_sound_and_bounded(sizes):
    lengths = np.array(sizes, np.int64)
    bins, offsets, loads = packing.best_fit_decreasing(lengths, 20)
    places = sorted(zip(bins.tolist(), offsets.tolist(), lengths.tolist()))
    for (b, o, n), (b2, o2, _) in zip(places, places[1:]):
        assert o2 == (o + n if b2 == b else 0)
    assert (loads <= 20).all() and loads.sum() == lengths.sum()
    assert packing.bin_lower_bound(lengths, 20) <= len(loads)


def _fewest(sizes, capacity):
    best = len(sizes)

    def go(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(sizes):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= sizes[at]:
                go(at + 1, [*rooms[:i], room - sizes[at], *rooms[i + 1 :]])
        go(at + 1, [*rooms, capacity - sizes[at]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_bound_never_exceeds_the_optimum(sizes):
    assert packing.bin_lower_bound(np.array(sizes), 12) <= _fewest(sorted(sizes, reverse=True), 12)


def test_round_trip(spark, documents):
    texts = [(0, "hello world"), (1, None), (2, ""), (3, "the " * 5000), (0, "hello world"), (None, "x"), (4, "of\n\nthe")]
    out = packing.pack_documents(documents(texts)).collect()
    assert sum(r["length"] for r in out) == sum(len(_ENCODER.encode(t)) // 4 + 1 for _, t in texts)
    third = sorted((r for r in out if r["doc_id"] == 3), key=lambda r: r["piece"])
    assert [r["start"] for r in third] == [0, 2048, 4096] and [r["length"] for r in third] == [2048, 2048, 905]
    whole = _ENCODER.encode("the " * 5000) + b"\0" * 4
    assert [r["ids_crc32"] for r in third] == [zlib.crc32(whole[4 * s : 4 * (s + 2048)]) for s in (0, 2048, 4096)]
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r["length"] for r in out) // 2048)
    assert packing.pack_documents(documents([])).count() == 0


def test_partitions_exchange(spark):
    items = spark.range(3000).selectExpr("id", "id * 7919 % 900 + 1 as length")
    out = packing.best_fit_pack(items, 2048, 500).collect()
    assert len(out) == 3000 and len({r["id"] for r in out}) == 3000
    loads = {}
    for r in out:
        loads[r["sequence_id"]] = loads.get(r["sequence_id"], 0) + r["length"]
    assert max(loads.values()) <= 2048 and len(loads) <= -(-sum(loads.values()) // 2048) + 2
