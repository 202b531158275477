"""Token counts, packing, id shards and sampling against the libraries themselves."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm.best_fit import op3_best_fit, plan, plan_in_jobs
from factloom.llm.memo_encode import MemoEncoder
from factloom.llm.piece_sampling import Lattice, op7_piece_sampling
from factloom.llm.token_shards import PerfectHash, key_hash, mix, op4_token_shards
from factloom.llm.token_transducer import Transducer, op1_token_counts


def noise(seed, letters, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


STRANGE = ["", " ", "  a   b \n\n c", "a\x1cb", "foo's 'some 's x 're 'rx 'r 'lla", "<|endoftext|> a", "ΑΣ. İx 12,3.4", "Ünïc. é ́ x", "日本語 ok 😀", "x" * 1000, "word. word, 12. !!. a.b., ok\n", "J\u030cabc H\u0331x", "T\u0308 W\u030a Y\u030a \u1fba\u0345 e\u0301 E\u0301", "A\u030a\u0323 \u212b \u0958 \u1100\u1161"]


def library(path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda t: own.encode(t, add_special_tokens=False).ids


def test_transducer_counts_as_the_library(path):
    own, ids = Transducer(path("word_bpe_49k.json")), library(path("word_bpe_49k.json"))
    texts = [*STRANGE, *noise(1, "abest  \n.,'1sé\t!rvlmd'", 600, 400), *noise(2, "thereandintionouß", 200, 600)]
    assert own.count(texts).tolist() == [len(ids(t)) for t in texts]


def test_transducer_forgets_and_goes_on(path):
    own = Transducer(path("word_bpe_49k.json"), bound_mb=0)
    assert own.count(["some words"]).tolist() == own.count(["some words"]).tolist() == [2]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_memo_encoder_is_the_library(path, name):
    own, ids = MemoEncoder(path(name), limit=50), library(path(name))
    for t in [*STRANGE, *noise(3, "ab  \n.,'1sé\t!", 800, 40)]:
        assert np.frombuffer(own.ids([t])[0], "<u4").tolist() == ids(t), t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_memo_encoder_on_marks_is_the_library(path, name):
    """Letters with marks, which compose before or after they are lower-cased, or not at all."""
    own, ids, rng = MemoEncoder(path(name)), library(path(name)), random.Random(13)
    letters, marks = [*map(chr, range(0x41, 0x250)), *map(chr, range(0x370, 0x400)), *map(chr, range(0x1E00, 0x2000)), *"AJHTWY \n" * 40], [*map(chr, range(0x300, 0x346)), "\u0653", "\u093c", "\u3099"]
    texts = ["".join(rng.choice(letters) + (rng.choice(marks) if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    same(own, ids, texts)
    if name.startswith("word"):
        mixed = np.frombuffer(own.ids(["J\u030cabc H\u0331x"])[0] + bytes(4), "<u4")
        assert (len(mixed), zlib.crc32(mixed.tobytes())) == (9, 2633816061)


def test_op1(spark, odd, none, path):
    ids = library(path("word_bpe_49k.json"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in op1_token_counts(odd, path("word_bpe_49k.json")).collect())
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(ids(r.text or "")), n > 2048) for r in odd.collect())
    assert got == want
    assert op1_token_counts(none, path("word_bpe_49k.json")).count() == 0


def test_op4(spark, odd, none, docs, path):
    ids = library(path("byte_bpe_50k.json"))
    for frame in (odd, docs):
        got = sorted((tuple(r) for r in op4_token_shards(frame, path("byte_bpe_50k.json")).collect()), key=lambda r: r[1])
        start, want = 0, []
        for r in sorted(frame.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
            own = [*ids(r.text or ""), 0]
            want.append((r.doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
            start += len(own)
        assert got == want
    assert op4_token_shards(none, path("byte_bpe_50k.json")).count() == 0


def test_perfect_hash_is_minimal():
    h = key_hash(np.arange(50_000), np.zeros(50_000, np.int64))
    slots = PerfectHash.build(h).slots(h)
    assert sorted(slots.tolist()) == list(range(50_000))
    assert len(np.unique(mix(h))) == 50_000
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5], np.uint64))


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms), sorted(rooms)


def test_plan_in_jobs_is_the_plan(spark):
    rng = random.Random(3)
    counts = {k: rng.randint(1, 9) for k in (1, 3, 5, 7, 11)}

    def places(intervals):
        out = {}
        for length in counts:
            own = sorted(x[1:] for x in intervals if x[0] == length)
            for (rank, sequence, offset), end in zip(own, [x[0] for x in own[1:]] + [counts[length]], strict=True):
                out.update({(length, r): (sequence + r - rank, offset) for r in range(rank, end)})
        return out

    jobs = plan_in_jobs(spark.createDataFrame(list(counts.items()), "length int, n long"), 12)
    assert places([tuple(r) for r in jobs.collect()]) == places([tuple(x) for x in plan(counts, 12)[0].tolist()])


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 120))]
        table, n = plan(Counter(lengths), 50)
        assert n == best_fit_decreasing(lengths, 50)[0]
        filled = Counter()
        ends = {}
        for length, rank, sequence, offset in table.tolist():
            following = [r for k, r, _, _ in table.tolist() if k == length and r > rank]
            for k in range(min(following, default=Counter(lengths)[length]) - rank):
                ends.setdefault(sequence + k, []).append((offset, offset + length))
                filled[length] += 1
        assert filled == Counter(lengths)
        for spans in ends.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= 50
        assert sorted(50 - s[-1][1] for s in ends.values()) == best_fit_decreasing(lengths, 50)[1]


def test_op3(spark, odd, none, path):
    ids = library(path("word_bpe_49k.json"))
    rows = op3_best_fit(odd, path("word_bpe_49k.json")).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        spans.sort()
        at = 0
        for offset, n in spans:
            assert offset == at
            at += n
        assert at <= 2048
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for r in odd.collect():
        own = [*ids(r.text or ""), 0]
        for i, at in enumerate(range(0, len(own), 2048)):
            part = own[at : at + 2048]
            want[r.doc_id, i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert got == want
    assert op3_best_fit(none, path("word_bpe_49k.json")).count() == 0


def test_sampling_is_lossless_and_keyed(path):
    own = Lattice(path("piece_bpe_32k.model"), 0.0005)
    texts = [*STRANGE, " x", "▁a", "\n\n", "a\n", "\x00z", *noise(5, "ab  \n▁é日t", 500, 40)]
    drawn = own.encode(np.arange(len(texts)), texts, 0)
    assert [own.decode(x) for x in drawn] == texts
    fresh = Lattice(path("piece_bpe_32k.model"), 0.0005)
    assert all(fresh.encode(np.array([k]), [texts[k]], 0)[0].tolist() == drawn[k].tolist() for k in range(0, 200, 7))


def test_sampling_has_the_right_distribution(path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    scores = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(259, model.get_piece_size())}
    word, weights = "▁ther", {}
    for m in range(2 ** (len(word) - 1)):
        cuts = [0, *[k + 1 for k in range(len(word) - 1) if m >> k & 1], len(word)]
        parts = [word[a:b] for a, b in zip(cuts, cuts[1:])]
        if all(p in scores for p in parts):
            weights[tuple(scores[p][0] for p in parts)] = math.exp(0.0005 * sum(scores[p][1] for p in parts))
    total, n = sum(weights.values()), 20_000
    seen = Counter(tuple(x.tolist()) for x in Lattice(path("piece_bpe_32k.model"), 0.0005).encode(np.arange(n), ["ther"] * n, 3))
    assert set(seen) <= set(weights)
    for s, w in weights.items():
        assert abs(seen[s] / n - w / total) < 0.02


def test_op7(odd, none, path):
    rows = op7_piece_sampling(odd, path("piece_bpe_32k.model")).collect()
    assert len(rows) == odd.count() and all(r.lossless for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (2, 3)} == {0}
    assert sorted(map(str, rows)) == sorted(map(str, op7_piece_sampling(odd.repartition(3), path("piece_bpe_32k.model")).collect()))
    assert op7_piece_sampling(none, path("piece_bpe_32k.model")).count() == 0


def test_long_units_are_filtered_as_short_ones(path):
    from factloom.llm import piece_sampling
    from factloom.llm.piece_sampling import Lattice

    rng = random.Random(8)
    units = [" " + "".join(rng.choice("etaoin shrdluéß日0▁".replace(" ", "")) for _ in range(n)) for n in (1, 5, 17, 120, 390)]
    short, long = Lattice(path("piece_bpe_32k.model"), 0.0005), Lattice(path("piece_bpe_32k.model"), 0.0005)
    slab, piece_sampling.SLAB = piece_sampling.SLAB, 7
    try:
        for u in units:
            short.filter([u])
            long.filter_long(u)
    finally:
        piece_sampling.SLAB = slab
    assert short.units == long.units and short.ends == long.ends and (short.first == long.first).all()
    assert (short.length == long.length).all() and (short.piece == long.piece).all() and np.allclose(short.cdf, long.cdf, atol=1e-5)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    (ids,) = short.encode(np.array([5]), [text], 0)
    assert short.decode(ids) == text


def test_counts_of_a_long_word_are_the_library_s(path):
    own, ids = Transducer(path("word_bpe_49k.json"), bound_mb=6), library(path("word_bpe_49k.json"))
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (127, 128, 129, 255, 256, 1000, 20_000)]
    texts += ["ab" * 3000, "a" * 5000, "'" * 700, "x1" * 900, " " + texts[5] + " " + texts[6]]
    assert own.count(texts).tolist() == [len(ids(t)) for t in texts]
    assert len(own.keys) * (4 * own.width + 1000) < 40_000_000


class Counted:
    """A tokenizer that keeps the texts it is given in batches."""

    def __init__(self, own):
        self.own, self.given = own, []

    def encode(self, *args, **more):
        return self.own.encode(*args, **more)

    def encode_batch_fast(self, texts, **more):
        self.given += texts
        return self.own.encode_batch_fast(texts, **more)


def counted(path):
    own = MemoEncoder(path)
    own.cache.tokenizer = own.spaced.tokenizer = out = Counted(own.tokenizer)
    return own, out


def same(own, ids, texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in own.ids(texts)] == [ids(t) for t in texts]


def test_new_words_go_to_the_library_in_lots(path):
    (own, seen), ids = counted(path("word_bpe_49k.json")), library(path("word_bpe_49k.json"))
    words = [w for w in noise(11, "abcdeéßñ日", 3000, 12) if w]
    same(own, ids, [" ".join(words), " ".join(w + "!?%" for w in words)])
    assert len(seen.given) < len(set(words)) / 20
    odd = ["x́", "Å", "ﬁ", "ǅ", "\U0001e4d0", "\U00031350", "ab\U00031350c", "don't", "'s", "x'", "x's.", "''", "a1b2", "ªº", "ⅷ", "x_y", "日本.", "ab́.", "abc̸", "abc≯", "İ"]
    for k in range(len(odd)):
        same(own, ids, [" ".join(odd[k:] + words[:k] + odd[:k]), odd[k]])


def test_special_strings_after_lower_casing_are_text(path):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        same(MemoEncoder(path(name)), library(path(name)), ["<|EndOfText|>x", "a <|ENDOFTEXT|>b <|startofTEXT|> c", "a <|endoftext|>b"])


def test_accents_are_no_unusual_white_space(path):
    (own, seen), ids = counted(path("byte_bpe_50k.json")), library(path("byte_bpe_50k.json"))
    words = [w for w in noise(12, "abcdeéßñ日.,'1", 3000, 9) if w]
    same(own, ids, [" ".join(words), "é\n" + " ".join(words), "\n".join(words)])
    assert len(own.cache) < 1.1 * len(set(words)) and len(seen.given) < len(set(words)) / 20
    spaces = [*"\x0b\x0c\x85\xa0", *map(chr, (0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))]
    wide = ["a" + c * n + "é" + c for c in spaces for n in (1, 2)]
    same(own, ids, [*wide, *(f"x {w} y\n{w} z" for w in wide)])
