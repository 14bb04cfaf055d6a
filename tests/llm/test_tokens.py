import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public = pytest.importorskip("public_tokenizers")

from heatline.llm import packing, token_files
from heatline.llm.batches import flat
from heatline.llm.tokens import Encoder

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(scope="module", params=NAMES)
def encoder(request):
    return Encoder(request.param)


def library(name, texts):
    """The library's own ids, with no setting touched."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path(name))
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_special_names_and_equal_hashes(name):
    """Names of special tokens anywhere, and words that any sum of letters modulo 2**64 takes for one."""
    names = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|", "|endoftext|>"]
    texts = [f"{a}{n}{b}" for n in names for a in ("", " ", "hello ", "x", "\n", "É,") for b in ("", " ", " there", "y.")]
    texts += ["".join(random.Random(k).choices([*names, " ", "a", "é "], k=9)) for k in range(50)]
    one = "a"
    for _ in range(10):
        one += one.translate({97: "b", 98: "a"})
    other = one.translate({97: "b", 98: "a"})
    texts += [one, other, f"{one} {other}", f"{other} {one}", *odd_texts(9, 100)]
    pick = random.Random(1)
    for _ in range(3):
        pick.shuffle(texts)
        ids, at = Encoder(name).encode(*flat(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library(name, texts)
    known = Encoder(name)
    for text in (one, other):
        assert known.encode(*flat(pa.array([text])))[0].tolist() == library(name, [text])[0]


def odd_texts(seed, n=300):
    pick = random.Random(seed)
    letters = ["a", "B", "é", "É", "ß", "İ", "ñ", " ", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "23", "-",
               " ", " ", "　", "́", "漢", "\U0001f600", "!!", "$", "The", "ing", "×", "µ"]
    return ["".join(pick.choices(letters, k=pick.randint(0, 40))) for _ in range(n)]


def test_parts_give_the_library_s_ids(encoder):
    texts = odd_texts(1) + ["", "don't.", "É,é.", "a.b,c", "x" * 3000]
    ids, at = encoder.encode(*flat(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == encoder.library(texts)


def test_a_full_memory_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr("heatline.llm.tokens.MOST_PARTS", 10)
    for seed in range(3):
        texts = odd_texts(seed, 50)
        ids, at = encoder.encode(*flat(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == encoder.library(texts)


@pytest.mark.parametrize("most", [3, 4, 8, 18])
def test_code_lengths_are_optimal_and_limited(most):
    rng = np.random.default_rng(most)
    for _ in range(20):
        counts = rng.integers(1, 1000, rng.integers(1, 9))
        lengths = token_files.code_lengths(counts, most)
        assert lengths.max() <= most
        assert sum(2.0 ** -int(x) for x in lengths) <= 1
        # Brute force over all length vectors of up to five symbols.
        if 1 < len(counts) <= 5 and most <= 4:
            from itertools import product

            best = min(
                int(np.dot(counts, ls))
                for ls in product(range(1, most + 1), repeat=len(counts))
                if sum(2.0**-x for x in ls) <= 1
            )
            assert int(np.dot(counts, lengths)) == best


def test_bits_round_trip():
    rng = np.random.default_rng(5)
    counts = np.maximum(1, (1e6 / np.arange(1, 3000) ** 1.3)).astype(np.int64)
    ids, lengths, codes = token_files.canonical(np.arange(len(counts)), token_files.code_lengths(counts))
    by_id = np.zeros((2, len(counts)), np.int64)
    by_id[:, ids] = codes, lengths
    symbols, sizes = np.zeros(1 << 18, np.uint32), np.zeros(1 << 18, np.int64)
    spans = 1 << (18 - lengths)
    symbols[: spans.sum()], sizes[: spans.sum()] = np.repeat(ids, spans), np.repeat(lengths, spans)
    for n in (1, 2, 255, 256, 257, 5000):
        values = rng.choice(len(counts), n, p=counts / counts.sum()).astype(np.uint32)
        bits, places = token_files.to_bits(values, *by_id)
        assert token_files.from_bits(bits, places, n, symbols, sizes).tolist() == values.tolist()


def wanted(texts, tokenizer, end_id):
    found = library(tokenizer, [t or "" for t in texts])
    return [ids + [end_id] for ids in found]


def test_files_hold_every_document(spark, edge_docs, no_docs, tmp_path):
    token_files.write(edge_docs, str(tmp_path / "a"), NAMES[0], end_id=1)
    rows = token_files.read(spark, str(tmp_path / "a")).collect()
    docs = edge_docs.collect()
    want = Counter(
        (d.doc_id, np.array(ids, "<u4").tobytes()) for d, ids in zip(docs, wanted([d.text for d in docs], NAMES[0], 1))
    )
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens * 4) == (at, len(r.ids))
        at += r.n_tokens
    names = [r.doc_id for r in rows if r.doc_id is not None]
    assert names == sorted(names) and rows[0].doc_id is None
    token_files.write(no_docs, str(tmp_path / "b"), NAMES[0], end_id=1)
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("capacity", [7, 2048])
def test_packing(edge_docs, capacity):
    rows = packing.packed(edge_docs, NAMES[1], 0, capacity).collect()
    docs = edge_docs.collect()
    want = Counter()
    for d, ids in zip(docs, wanted([d.text for d in docs], NAMES[1], 0)):
        many = -(-len(ids) // capacity)
        at = 0
        for piece in range(many):
            n = len(ids) - (many - 1) * capacity if piece == 0 else capacity
            crc = zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
            want[d.doc_id, piece, at, n, crc] += 1
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_no_documents_pack_to_nothing(no_docs):
    assert packing.packed(no_docs, NAMES[1], 0, 2048).count() == 0


def test_plan_is_close_to_the_least():
    rng = np.random.default_rng(7)
    for _ in range(30):
        capacity = int(rng.integers(3, 200))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 3000))
        counts = Counter(lengths.tolist())
        entries, sequences = packing.plan(counts, capacity)
        filled = Counter()
        placed = Counter()
        for e in entries:
            n = min([x.rank for x in entries if x.length == e.length and x.rank > e.rank], default=counts[e.length]) - e.rank
            placed[e.length] += n
            for k in range(n):
                filled[e.sequence + k // e.each] += e.length
        assert placed == counts
        assert max(filled.values()) <= capacity and len(filled) == sequences
        least = math.ceil(lengths.sum() / capacity)
        large = sum(1 for x in lengths if 2 * x > capacity)
        assert sequences <= max(least, large) * 1.12 + 2
