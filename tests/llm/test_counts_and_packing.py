import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from adloom.llm.packing import Encoder, best_two_fit, pack, packed_documents, slots
from adloom.llm.tokencount import LongestMatch, byte_pieces, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def greedy(word, pieces, begin=b" "):
    """Pieces of a word, longest first; one if it cannot be cut."""
    rest, n = begin + word, 0
    while rest:
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), 0)
        if not size:
            return 1
        rest, n = rest[size:], n + 1
    return n


def test_automaton_equals_greedy_search_on_random_vocabularies():
    rng = random.Random(1)
    for _ in range(2000):
        word = lambda low, high: bytes(rng.choice(b"abc") for _ in range(rng.randint(low, high)))
        pieces = {word(1, 5) for _ in range(rng.randint(1, 8))} | {b" " + word(0, 3) for _ in range(3)}
        made, asked = LongestMatch(pieces), word(1, 12)
        assert made.count(asked) == greedy(asked, pieces)


def test_token_counts(make_docs, texts):
    pieces = set(byte_pieces(VOCABULARY))
    got = {r.doc_id: r for r in token_counts(make_docs(texts)).collect()}
    for k, text in enumerate(texts):
        words = [w for w in (text or "").encode().split()]
        if len(max(words, default=b"")) > 1000:
            words = []
        each = [greedy(w, pieces) for w in words]
        if words or not (text or "").split():
            want = (len(words), sum(each), max(each, default=0), len((text or "").encode()))
            assert tuple(got[k].tokens) == want
        assert got[k].words == "words"


def test_token_counts_of_nothing(make_docs):
    assert token_counts(make_docs([])).collect() == []
    twice = token_counts(make_docs([(1, "a b"), (1, "a b"), (None, None)])).select("doc_id", "tokens.n_tokens").collect()
    assert sorted(map(tuple, twice), key=str) == [(1, 2), (1, 2), (None, 0)]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    rng, own, theirs = random.Random(2), Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    parts = [" ", "  ", "\n", "\t", "a", "word", ".", ",", "'s", "é", "中文", "12", "<|endoftext|>", "\x1c", "　", "\0", "\xad"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(5000)]
    want = [np.asarray(x.ids, "<u4").tobytes() for x in theirs.encode_batch(made, add_special_tokens=False)]
    assert own.encode(made) == want


def one_by_one(lengths, limit):
    """Best-two-fit piece by piece."""
    left, bins = sorted(lengths), []
    while left:
        bin_, gap = [], limit
        while fits := [x for x in left if x <= gap]:
            left.remove(fits[-1])
            bin_.append(fits[-1])
            gap -= fits[-1]
        if gap and len(bin_) > 1:
            pairs = [(a + b, b, a) for i, a in enumerate(left) for b in left[i + 1 :] if bin_[-1] < a + b <= gap + bin_[-1]]
            if pairs:
                total = max(p[0] for p in pairs)
                left.append(bin_.pop())
                bin_.append(total)
                _, b, a = next(p for p in pairs if p[0] == total)
                left.remove(a)
                left.remove(b)
                left.sort()
        bins.append(sum(bin_))
    return bins


def test_best_two_fit_is_that_of_single_pieces():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 90))]
        bins = best_two_fit(dict(Counter(lengths)), 40)
        used = Counter()
        for sizes, times in bins:
            assert sum(sizes) <= 40
            used.update({s: n * times for s, n in Counter(sizes).items()})
        assert used == Counter(lengths)
        assert abs(sum(t for _, t in bins) - len(one_by_one(lengths, 40))) <= 1
        assert -(-sum(lengths) // 40) <= sum(t for _, t in bins)


def test_two_fill_a_gap_better_than_one():
    assert best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [((6, 2, 2), 1), ((3,), 1)]
    with pytest.raises(ValueError):
        best_two_fit({11: 1}, 10)


def test_slots_hold_every_piece_once():
    rows = slots(best_two_fit({5: 7, 3: 9, 2: 4}, 10))
    assert sum(last - first + 1 for _, first, last, *_ in rows) == 20


def gapless(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return by


def test_packed_documents(make_docs, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(VOCABULARY)
    rows = packed_documents(make_docs([*texts, *texts[:3]])).collect()
    want = Counter()
    ids_of = {}
    for k, text in enumerate([*texts, *texts[:3]]):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[k, piece, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())] += 1
        ids_of[k] = ids
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    total = sum(map(len, ids_of.values()))
    assert len(gapless(rows, 1024)) <= total / 1024 * 1.1 + 2


def test_one_length_for_most_pieces_and_few_shards(spark):
    cut = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "if(id % 3 = 0, 7L, id % 11 + 1) as length")
    rows = pack(cut, 16, shards=3).collect()
    assert len(rows) == 5000
    assert len(gapless(rows, 16)) <= sum(r.length for r in rows) / 16 * 1.05 + 2


def test_packing_nothing_and_null_ids(make_docs):
    assert packed_documents(make_docs([])).collect() == []
    rows = packed_documents(make_docs([(None, None), (None, "a"), (None, "a")])).collect()
    assert sorted(r.length for r in rows) == [1, 2, 2] and len(gapless(rows, 1024)) == 1


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    from adloom.llm.packing import Encoder

    plain, made = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    assert made.fast is not None
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200)]]
    every = [f"a{c}1 {c}.{c}" for c in points]
    runs = [x * 30_000 for x in ("a", " ", "\n", " \t", "#", "1", "ab ", "字")]
    special = ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext", ""]
    for k in range(0, len(every), 50_000):
        part = every[k : k + 50_000] + (runs + special if k == 0 else [])
        want = [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch(part, add_special_tokens=False)]
        assert made.encode(part) == want


def test_other_vocabularies_go_through_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    from adloom.llm.packing import Encoder

    found = json.load(open(VOCABULARY, encoding="utf-8"))
    found["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "prefixed.json"
    path.write_text(json.dumps(found), encoding="utf-8")
    made, plain = Encoder(str(path)), Tokenizer.from_file(str(path))
    assert made.fast is None
    ids = plain.encode("two words", add_special_tokens=False).ids
    assert made.encode(["two words", ""]) == [np.array(ids, "<u4").tobytes(), b""]
