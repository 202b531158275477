"""Exact and near duplicates against brute force, and the pipeline."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm.jaccard_join import key_of, one_of_each, op6_jaccard_join, packed, shared_in, shingles
from factloom.llm.stream_dedup import DigestState, distinct_documents, groups, op5_exact_dedup


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def exact(rows):
    own = {}
    for i, t in rows:
        own.setdefault(normal(t), []).append(i)
    first = lambda ids: None if None in ids else min(ids)
    return {t: (first(ids), len(ids)) for t, ids in own.items()}


def test_op5(spark, odd, none, docs):
    for frame in (odd, docs):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        want, got = exact(rows), op5_exact_dedup(frame).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, *want[normal(t)], sha256(normal(t).encode()).hexdigest()) for i, t in rows)
        assert sum(r.kept for r in got) == len(want) and all(r.doc_id == r.keep_id for r in got if r.kept)
        kept = distinct_documents(frame)
        assert kept.columns == frame.columns and kept.count() == len(want)
    assert op5_exact_dedup(none).count() == 0 and distinct_documents(none).count() == 0


def test_digest_collisions_are_found(docs):
    weak = lambda t: F.encode(F.substring(F.sha2(t.cast("binary"), 256), 1, 1), "utf-8")
    _, got = groups(docs, weak)
    _, want = groups(docs)
    pick = lambda f: Counter((r.doc_id, r.keep_id, r.n) for r in f.select("doc_id", "keep_id", "n").collect())
    assert pick(got) == pick(want)


def test_state_goes_on(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    rows = lambda *r: spark.createDataFrame([(k.encode(), i, "f", i) for k, i in r], "digest binary, doc_id long, file string, row long")
    rows(("a", 5), ("b", 6)).write.parquet(f"{folder}/rows")
    assert {(r.doc_id, r.n) for r in DigestState(spark, folder).run().collect()} == {(5, 1), (6, 1)}
    rows(("a", 3), ("c", 7)).write.mode("append").parquet(f"{folder}/rows")
    assert {(r.doc_id, r.n) for r in DigestState(spark, folder).run().collect()} == {(3, 2), (6, 1), (7, 1)}


def linked_components(rows):
    sets, parent, index = [], list(range(len(rows))), {}
    for k, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets.append(s)
        for x in s:
            index.setdefault(x, []).append(k)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in index[x] if j < k).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[find(k)] = i if first.get(find(k)) is None else min(x for x in (i, first[find(k)]) if x is not None) if i is not None else first[find(k)]
    return Counter((i, len(sets[k]), first[find(k)]) for k, (i, _) in enumerate(rows))


def made_up(spark, seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 60))] for _ in range(20)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        own = list(rng.choice(bases)) + (passage if rng.random() < 0.3 else [])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(own) if rng.random() > 0.02 else None))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("what", ["odd", "docs", "made up"])
def test_op6(spark, odd, docs, what):
    frame = {"odd": odd, "docs": docs}.get(what) if what != "made up" else made_up(spark, 5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in op6_jaccard_join(frame).collect())
    want = linked_components([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])
    assert got == want


def test_op6_without_rows(none):
    assert op6_jaccard_join(none).count() == 0


def test_one_of_each_component_stays(spark):
    frame = made_up(spark, 6, 150)
    parts = linked_components([(r.doc_id, r.text) for r in frame.collect()])
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in parts})


def test_short_texts_are_one_shingle():
    assert len(shingles("")) == len(shingles(" \n")) == 0
    assert len(shingles("one two")) == len(shingles("one two three four five")) == 1
    assert len(shingles("a b c d e f")) == 2 and (shingles("A  b\tc d e") == shingles("a b c d e")).all()
    assert len(shingles("É b c d e")) == 1 and shingles("É b c d e") != shingles("é b c d e")


def test_pipeline_against_brute_force(spark, sf, path):
    """Ids are the library's own here, and packing is checked by what a packing must be, not by the operator."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from factloom.llm.personal_data import all_spans, masked, trained
    from factloom.llm.quality_gam import op8_quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    strange = spark.createDataFrame([(9_000_001, "J\u030cabc H\u0331x T\u0308"), (9_000_002, None)], "doc_id long, text string")
    good = {r.doc_id for r in op8_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    rows = [(i, t) for i, t in rows if exact(rows)[normal(t)][0] == i]
    keep = {c for _, _, c in linked_components(rows)}
    rows = [(i, masked(t, all_spans([t], trained())[0][1])) for i, t in rows if i in keep]
    library = Tokenizer.from_file(path("word_bpe_49k.json"))

    def pieces(texts):
        out = Counter()
        for i, t in texts:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
            for k, at in enumerate(range(0, len(ids), 2048)):
                part = ids[at : at + 2048]
                out[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        return out

    for got, want in ((corpus_pipeline.run(spark, sf), rows), (corpus_pipeline.packing(spark, strange, sf), [tuple(r) for r in strange.collect()])):
        found = got.collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == pieces(want)
        held = {}
        for r in found:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in held.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 2048
        total = sum(r.length for r in found)
        assert len(held) <= -(-total * 11 // 9 // 2048) + 1  # what best fit decreasing promises of the fewest there can be
    assert len(corpus_pipeline.STAGES) == 5


def test_op6_rows_without_id_bridge_others(spark):
    base = [f"w{i}" for i in range(104)]
    but = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    rows = [(7, but()), (None, but(20, 50)), (3, but(20, 50, 10, 80)), (5, "alone"), (None, " ".join(base[::-1])), (None, " ".join(base[::-1][:-1])), (None, None)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in op6_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == linked_components(rows) and got[None, 100, 3] == got[7, 100, 3] == 1


def test_op6_long_words_of_two_letters_differ(spark):
    swap = str.maketrans("ab", "ba")
    word = "a"
    while len(word) < 4096:
        word += word.translate(swap)
    other = word.translate(swap)
    rows = [(1, f"{word} and some more words"), (2, f"{other} and some more words"), (3, word), (4, other)]
    got = {r.doc_id: r.component_id for r in op6_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_dedup_stages_keep_rows_with_odd_columns(spark, odd, none):
    names = ["__file", "__row", "__uid", "own", "f", "r", "file", "row", "key"]
    wide = odd.drop("key").select("*", *(F.lit(n).alias(n) for n in names))
    texts = lambda frame: Counter((r.doc_id, r.text, r["__file"]) for r in frame.collect())
    exactly, nearly = distinct_documents(wide), one_of_each(wide)
    assert exactly.columns == nearly.columns == wide.columns
    assert sorted(str(r.doc_id) for r in exactly.collect()) == ["1", "2", "4", "5", "6", "7", "8", "9", "None"]
    assert sorted(str(r.doc_id) for r in nearly.collect()) == ["1", "2", "3", "4", "5", "6", "7", "9", "None"]
    assert sum(texts(nearly).values()) == 9 and all(k[2] == "__file" for k in texts(nearly))
    for stage in (distinct_documents, one_of_each):
        assert stage(none).columns == none.columns and stage(none).count() == 0


def test_common_shingles_travel_once_a_block():
    sets = [shingles(f"the same five words here and then word{i} alone") for i in range(50)]
    rows = [r for b in packed(sets, [key_of(s) for s in sets], [1] * 50, 3, 7) for r in b.to_pylist()]
    hashes = [h for r in rows for h in memoryview(r["hashes"]).cast("Q")]
    assert len(hashes) == len(set(hashes)) == len({int(h) for s in sets for h in s})
    once = lambda rows: {bytes(k.tobytes()): int(n) for r in rows for k, n in zip(*(lambda x: (x[0], x[2]))(shared_in([(r["hashes"], r["places"], r["keys"], r["needs"], r["local"])]))) if n}
    total = Counter()
    for r in rows:
        total.update(once([r]))
    common = Counter(int(h) for s in sets for h in s)
    assert total == {key_of(s): sum(common[int(h)] > 1 for h in s) for s in sets}
