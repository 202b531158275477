"""Ranked search, archives and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import resampling, warc_zstd
from factloom.llm.block_max import op11_search
from factloom.llm.resampling import WordTrie, op13_resample, resample
from factloom.llm.warc_zstd import Damaged, frames, op12_warc, page_record, parsed, read_archives, revisits, write_archives
from factloom.llm.words import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def test_words_are_the_pattern_s():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice([chr(rng.randrange(0x250)), rng.choice("aB9 é_日😀\x85\xa0 ")]) for _ in range(40))
        assert [w.decode() for w in words(t)] == plain_words(t)


def ranking(docs, items, top=20):
    held = [(i, Counter(plain_words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(plain_words(t))
    out = {}
    for item, q in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in q.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out[item] = [(i, -s) for s, _, i in sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top]]
    return {k: v for k, v in out.items() if v}


def found(frame):
    out = defaultdict(dict)
    for r in frame.collect():
        assert r.rank not in out[r.item_id]
        out[r.item_id][r.rank] = (r.doc_id, r.score)
    return {k: [v[i + 1] for i in range(len(v))] for k, v in out.items()}


def test_op11(spark, odd, none, docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    asked, rows = [(r.item_id, r.text) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()]
    want = ranking(rows, asked)
    for size, terms, parts in ((128, 2_000_000, 1), (3, 300, 5)):
        assert found(op11_search(docs.repartition(parts), items, size=size, terms=terms)) == want
    odd_items = spark.createDataFrame([(1, "the fox, x", "a"), (1, "the lazy", "a"), (1, "the lazy", "a"), (None, "SAME words no 日本", "b"), (3, None, "c"), (4, " .,", "d"), (5, "zzz", "e")], "item_id long, text string, doc_id string")
    assert found(op11_search(odd, odd_items, size=2)) == ranking([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in odd_items.collect()])
    assert op11_search(none, items).count() == op11_search(docs, items.where("false")).count() == 0


def test_ties_go_to_small_ids_and_hot_copies_rank_once_each(spark):
    rows = [(k, "red green blue" if k % 3 else "red red") for k in range(400)] + [(None, "red red")] * 3
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "red"), (2, "blue red red"), (3, "green")], "item_id long, text string")
    assert found(op11_search(frame, items, size=8, top=30)) == ranking(rows, [(1, "red"), (2, "blue red red"), (3, "green")], 30)


# --- archives ----------------------------------------------------------------------------------------------------------

BIG = "<html>" + "same page é " * 100
PAGES = [(1, "http://a/ b\r\nX: y", BIG, 0), (5, "http://a/é", BIG, 0), (3, None, BIG, 0), (5, "again", BIG, 0), (7, "u", "short", 0), (8, "u", "short", 0), (9, "u", None, 0), (10, "u", "", 0), (None, "n", BIG, 0), (None, "n", "x" * 1000, 0), (None, "n", "x" * 1000, 0), (11, "u", "x" * 999, 0), (12, "u", "x" * 999, 0), (13, "u", "日" * 400_000 + "\r\n\r\nHTTP/1.1 \x00", 0)]
PAGES_DDL = "page_id long, url string, html string, refers_to int"


def stored(rows):
    largest = defaultdict(list)
    for i, _, h, _ in rows:
        largest[h or ""].append(i)
    out = Counter()
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        keep = max((x for x in largest[h or ""] if x is not None), default=None) if len(raw) >= 1000 else i
        out[i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if i == keep else "revisit", None if i == keep else keep] += 1
    return out


@pytest.mark.parametrize("hot", [1, 1000])
def test_op12(spark, monkeypatch, hot):
    monkeypatch.setattr(warc_zstd, "HOT", hot)
    pages = spark.createDataFrame(PAGES, PAGES_DDL)
    assert Counter(tuple(r) for r in op12_warc(pages.repartition(3)).collect()) == stored(PAGES)
    assert op12_warc(pages.where("false")).count() == 0


def test_archives_round_trip(spark, sf, tmp_path):
    base, rows = f"file://{tmp_path}/w", spark.read.parquet(f"{sf}/pages.parquet")
    doubled = rows.unionByName(rows.withColumn("page_id", F.col("page_id") + 100_000)).repartition(2)
    manifest = write_archives(revisits(doubled), base, "2020-01-01T00:00:00Z", limit=1)
    got = {r.page_id: r for r in read_archives(manifest, base).collect()}
    assert manifest.count() == doubled.count() > 2 and len(got) == doubled.count()
    for r in doubled.collect():
        own = got[r.page_id]
        big = len(r.html.encode()) >= 1000
        assert own.url == r.url and own.payload_bytes == len(r.html.encode())
        assert own.refers_to == (r.page_id + 100_000 if big and r.page_id < 100_000 else None)
        assert own.payload == (b"" if own.record_type == "revisit" else r.html.encode())
    more = manifest.withColumn("records", F.col("records") + 1)
    with pytest.raises(Exception, match="records are told"):
        read_archives(more, base).count()


def written_file(tmp_path, n=600):
    rng = random.Random(3)
    file = warc_zstd.ArchiveFile(f"file://{tmp_path}", "2020-01-01T00:00:00Z")
    records = [page_record(k, f"http://h/{k}", (" ".join(rng.choice(["<p>", "some", "words", str(rng.random())]) for _ in range(300))).encode(), None, "2020-01-01T00:00:00Z") for k in range(n)]
    for r in records:
        file.add(r)
    file.close()
    return f"{tmp_path}/{file.name}", records


def chunked(raw, size):
    return (raw[k : k + size] for k in range(0, len(raw), size))


def test_dictionary_stands_in_front_and_frames_hold_one_record(tmp_path):
    import zstandard

    name, records = written_file(tmp_path)
    raw = open(name, "rb").read()
    assert raw[:4] == warc_zstd.SKIPPABLE
    for size in (7, 1000, 1 << 20):
        assert [c for _, c in frames(chunked(raw, size))][1:] == records
    size = int.from_bytes(raw[4:8], "little")
    plain = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size])
    assert plain[:4] == warc_zstd.TRAINED
    again = warc_zstd.SKIPPABLE + len(plain).to_bytes(4, "little") + plain + raw[8 + size :]  # a dictionary that isn't compressed
    assert [c for _, c in frames(chunked(again, 4096))][1:] == records
    none, few = written_file(tmp_path, 3)
    assert open(none, "rb").read(4) == warc_zstd.FRAME and [c for _, c in frames(chunked(open(none, "rb").read(), 99))][1:] == few


def test_damage_is_told(tmp_path):
    name, records = written_file(tmp_path, 500)
    raw = open(name, "rb").read()
    for bad in (raw[:-1], raw[:2000], raw[:-300] + bytes([raw[-300] ^ 255]) + raw[-299:], raw + b"tail", raw[:8] + b"\0" * 8 + raw[16:], b"none of this"):
        with pytest.raises(Damaged):
            for _, c in frames(chunked(bad, 1 << 16)):
                parsed(c)
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Date: ", b"No-Date: "), (b"WARC-Type: ", b"WARC-Type "), (b"some", b"sume"), (b"\r\n\r\n", b"\n\n"), (b"WARC-Date: ", b"WARC-Type: x\r\nWARC-Date: ")):
        with pytest.raises(Damaged):
            warc_zstd.page_fields(*parsed(records[0].replace(old, new, 1)))
    block = parsed(records[0])[1]
    headers = parsed(records[0])[0]
    with pytest.raises(Damaged):
        warc_zstd.page_fields(headers, block + b"x")


# --- resampling --------------------------------------------------------------------------------------------------------


def features(t):
    w = plain_words(t)
    return w + [a + " " + b for a, b in zip(w, w[1:])]


def resampled(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)))
    for x in target:
        t.update(map(bucket, features(x)))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000))))
    rows = []
    for i, x in docs:
        f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x))))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = defaultdict(list)
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        ranks[r].append(k + 1)
    return Counter((*r[:4], ranks[r].pop(0) if ranks[r] else None) for r in rows)


def test_op13(spark, odd, none, docs, sf):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [r.text for r in target.collect()]
    for frame in (odd, docs.repartition(5)):
        got = Counter(tuple(r) for r in op13_resample(frame, target).select("doc_id", "n_features", "weight", "score", "rank").collect())
        assert got == resampled([(r.doc_id, r.text) for r in frame.collect()], texts)
    assert op13_resample(none, target).count() == 0
    assert op13_resample(docs, target.where("false")).where("rank is not null").count() == sum(r[4] is not None for r in resampled([(r.doc_id, r.text) for r in docs.collect()], []).elements())
    whole = resample(docs, target)
    assert whole.columns == docs.columns
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in op13_resample(docs, target).where("rank is not null").collect())


def test_many_equal_rows_get_each_a_rank(spark):
    rows = [(None, "one two three " * 9)] * 300 + [(k, "four five six seven " * 7) for k in range(100)] + [(5, "four five six seven " * 7)] * 3
    got = op13_resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame([(1, "six")], "item_id long, text string"))
    own = Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert own == resampled(rows, ["six"]) and sorted(k[4] for k in own if k[4]) == list(range(1, 101))


def test_lots_of_any_size_count_the_same(spark, docs):
    rows = docs.select("doc_id", "text")
    assert (resampling.bucket_totals(rows, chars=50) == resampling.bucket_totals(rows)).all()


def test_nodes_hold_the_crc_of_their_path():
    rng = random.Random(4)
    letters = [*"abAB9 ., ", "é", "日", "😀", "x" * 63, "y" * 64, "z" * 65, "w" * 5000, " "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", " ", ".,", "a"]
    for lot in (texts, [], [""], ["", " ", ""], ["one"], ["a b"]):
        trie = WordTrie(lot)
        want = Counter(zlib.crc32(f.encode()) % 97 for t in lot for f in features(t))
        assert trie.totals(97).tolist() == [want[k] for k in range(97)]
        assert trie.words().tolist() == [len(plain_words(t)) for t in lot]
        gain = resampling.np.array([rng.randint(-9, 9) for _ in range(97)])
        n, sums = trie.weights(gain)
        assert n.tolist() == [len(features(t)) for t in lot]
        assert sums.tolist() == [sum(gain[zlib.crc32(f.encode()) % 97] for f in features(t)) for t in lot]
