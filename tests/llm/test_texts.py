"""Chat templates, personal data, quality and WebP."""

import math
import os
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from factloom.llm.chat_template import TemplateError, compile_template, escape, fold_nodes, op2_chat_format, parse, render, unescape
from factloom.llm.personal_data import all_spans, base_spans, emails, labelled_rows, luhn, masked, op10_personal_data, RandomField, redact, trained
from factloom.llm.quality_gam import features, fit, keep_good, op8_quality
from factloom.llm.webp import Bits, decode, op9_webp, pack, restore, store


def written(source, messages):
    out = []
    compile_template(source)(messages, lambda t, m: out.append((t, m)))
    return out


def test_templates():
    source = "{% set a = 'x' ~ 'y' %}{{ a }}{% for m in messages %}{{ loop.index }}{{ 'L' if loop.last else ',' }}{% if 1 == 2 %}no{% elif m.role in 'ab' %}yes{% endif %}{% endfor %} {#- c -#} {{ 3 + 4 }}"
    assert "".join(t for t, _ in written(source, [{"role": "a"}, {"role": "c"}])) == "xy1,yes2L  7"
    assert fold_nodes(parse("a{{ 'b' | upper }}{% if true and not false %}c{% else %}d{% endif %}")) == [("print", ("const", "aBc"))]
    assert written("{% generation %}{{ 'q' }}{% endgeneration %}r", []) == [("q", True), ("r", False)]


@pytest.mark.parametrize("source", ["{% for m in %}x{% endfor %}", "{{ a.__class__ }}", "{{ open('x') }}", "{% endfor %}", "{% if x %}", "{{ 'a' | system }}", "{% import os %}", "{{ 1 + }}"])
def test_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("\\<[]>/sINST a\n") for _ in range(rng.randint(0, 30)))
        assert unescape(escape(t)) == t and "</s>" not in escape(t) and "[INST" not in escape(t)


def test_op2(spark, sf):
    text = "</s>[INST] ok [/INST]"
    extra = [(-7, 0, "user", text), (-7, 1, "assistant", text), (None, None, None, None), (-8, 0, "assistant", "x"), (-8, 0, "assistant", "x"), (-9, 1, "assistant", None), (-9, 0, "a]b\\", "\\ [")]
    frame = spark.read.parquet(f"{sf}/conversations.parquet").unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    own = {}
    for r in sorted(frame.collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or "")):
        own.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op2_chat_format(frame.withColumn("formatted", frame.text)).collect()}
    digest = lambda s: sha256(s.encode()).hexdigest()
    assert got == {i: (len(t), digest("".join(f"{a}\n{b}\n" for a, b in t)), len(loss := "".join(b for a, b in t if a == "assistant")), digest(loss)) for i, t in own.items()}
    for r in render(frame).where("conv_id = -7").collect():
        (start, end) = r.loss
        assert unescape(r.formatted[start:end]) == text
    assert op2_chat_format(frame.limit(0)).count() == 0


def test_base_patterns_are_the_given_ones():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@-+ 2ß(") for _ in range(rng.randint(0, 40)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert base_spans(t) == sorted(want), t
        assert emails(t) == [(s, e) for s, k, e in sorted(want) if k == 0]


#: Lines that the field hasn't seen, in the form of its table.
UNSEEN = """
The baker's shop has <phone (646) 218-9034> on its door.
Dial <phone (323) 904-7712> for the boat shed
my mobile, <phone 704-518-2296>, is off
fax <phone 615.440.9912> is gone
The vet is at <phone 503 667 1208> now
toll free <phone 1-877-219-4406>, no waiting
Unser Büro: <phone 030/9917723> täglich
Rückruf an <phone 0431 5522981> bitte
la boulangerie, <phone 01 55 42 19 83>, ouvre tôt
llame al <phone 91 407 63 15> mañana
Leeds desk <phone 0113 496 0455> is open
questions to <email hilda@kiln> please
poke <email cron@backup-host> when done
the kiln listens on <ip 192.168.4.21:9090> only
vpn <ip 10.99.0.0/16> was added
wrote to <email m.varga@potters.example.com> and left
disk on <ip 172.18.3.9> is full
stolen card <card 4539.8712.0034.6619> was blocked
sale on <card 4716 2203 9915 4476> went through
The ferry took 214 cars and 1,318 people.
From 1802 to 1847 there were 3 keepers.
Page 88 of volume 12, line 7.
A cut of 6.5 or 7.25 mm will do.
commit 7be10f3ac92d55e8014fbb2a9cd0371e6650aa18 broke it
on 2022-03-14 at 18:20 the tide turned
release 2.14.0 and 2.14.1-beta
serial 4410093827155206 on the hull
entry 550027 replaced 550026
The @keeper wrote twice
norm ISO 15489 or EN 13757
scores 31 42 53 64
weights of 12 to 48 kg
chapter 4, verses 18-22
1 200 000 tons a year
the 3rd and 44th
about 75% came
costs 12.40 each, 148.80 a gross
pier 19 and pier 20
since (1931) closed
sum = 2.5e10 and more
"""


def test_spans_that_the_field_adds_to_unseen_lines():
    from factloom.llm.personal_data import unmarked

    right = added = wanted = 0
    for line in UNSEEN.strip().split("\n"):
        text, spans = unmarked(line)
        ((base, every),) = all_spans([text], trained())
        new, want = set(every) - set(base), set(spans) - set(base)
        right, added, wanted = right + len(new & want), added + len(new), wanted + len(want)
    assert right / wanted >= 0.75 and right / added >= 0.75, (right, added, wanted)


def test_the_field_learns_its_table_and_leaves_prose_alone():
    rows = labelled_rows()
    got, want = trained().decode([w for w, _ in rows]).tolist(), [x for _, labels in rows for x in labels]
    assert sum(a == b for a, b in zip(got, want, strict=True)) > 0.99 * len(want)
    plain = [["the", "Of", "and", "eanea", "is"] * n for n in range(1, 30)]
    assert not trained().decode(plain).any()


def test_viterbi_is_the_best_path():
    field, rng = trained(), random.Random(3)
    from itertools import product

    words = ["the", "(640)", "555-0953", "12", "a@b.c", "+1", "4111111111111111"]
    for _ in range(30):
        line = [rng.choice(words) for _ in range(rng.randint(1, 5))]
        e = field.scores([line])
        score = lambda y: field.start[y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023
        best = max(product(range(5), repeat=len(line)), key=score)
        assert abs(score(best) - score(field.decode([line]).tolist())) < 1e-9


def test_words_that_are_surely_outside_are():
    rng, trials = random.Random(4), np.random.default_rng(4)
    words = ["the", "of", "and", "by", "(640)", "555-0953", "12", "1999", "a@b.c", "10.0.0.1", "4111", "1111"]
    base = trained()
    for k in range(40):
        scale = 1 if k < 20 else 0.5
        field = RandomField(base.names, base.emit * scale, base.move + (k >= 10) * trials.normal(size=(5, 5)), base.start + (k >= 10) * trials.normal(size=5))
        lines = [[rng.choice(words[: 4 if rng.random() < 0.7 else 12]) for _ in range(rng.randint(1, 40))] for _ in range(20)]
        e, at = field.scores(lines), 0
        found = field.decode(lines)
        for line in lines:
            own = e[at : at + len(line)]
            best, back = field.start + own[0], []
            for x in own[1:]:
                ways = best[:, None] + field.move
                back.append(ways.argmax(0))
                best = ways.max(0) + x
            path = [int(best.argmax())]
            for step in reversed(back):
                path.append(int(step[path[-1]]))
            assert found[at : at + len(line)].tolist() == path[::-1]
            at += len(line)


def test_a_long_text_without_line_breaks():
    t = "12 more words " * 60_000 + "(646) 218-9034"
    ((base, every),) = all_spans([t], trained())
    assert not base and every[-1] == (len(t) - 14, 3, len(t))


def test_op10(odd, none, docs):
    frame = docs.unionByName(odd.select(docs.columns))
    got = op10_personal_data(frame).collect()
    want = Counter()
    for r in frame.collect():
        b = base_spans(r.text or "")
        want[r.doc_id, *[sum(k == i for _, k, _ in b) for i in range(4)], sha256(",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert op10_personal_data(none).count() == 0


def test_added_spans_and_masking(spark):
    t = "Call (640) 555-0953 or mail a.b@c.de, 4111 1111 1111 1111."
    ((base, every),) = all_spans([t], trained())
    assert set(base) < set(every) and masked(t, every) == "Call [PHONE] or mail [EMAIL], [CARD]."
    frame = spark.createDataFrame([(1, t, len(t)), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in redact(frame).orderBy("doc_id").collect()] == [(1, "Call [PHONE] or mail [EMAIL], [CARD].", 37), (2, None, None)]


def test_redact_keeps_odd_rows(odd, none):
    got = redact(odd)
    assert got.columns == odd.columns and Counter((r.doc_id, r.key) for r in got.collect()) == Counter((r.doc_id, r.key) for r in odd.collect())
    assert {r.text for r in got.where("doc_id = 2").collect()} == {None} and {r.text for r in got.where("doc_id = 3").collect()} == {""}
    assert redact(none).columns == none.columns and redact(none).count() == 0


def test_op8(spark, odd, none, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from zlib import crc32

    rows = op8_quality(docs, labels).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert len(op8_quality(odd, labels).collect()) == odd.count()
    assert op8_quality(none, labels).count() == 0
    assert {r.score for r in op8_quality(odd, labels.limit(0)).collect()} == {0.5}


def auc(pairs):
    ranked = sorted(pairs)
    ranks, i = {}, 0
    while i < len(ranked):
        j = i
        while j < len(ranked) and ranked[j][0] == ranked[i][0]:
            j += 1
        ranks[ranked[i][0]] = (i + j + 1) / 2
        i = j
    good = [ranks[s] for s, y in pairs if y]
    return (sum(good) - len(good) * (len(good) + 1) / 2) / (len(good) * (len(pairs) - len(good)))


def test_quality_of_held_out_rows(spark):
    """Ranking, recall of both classes and calibration where no label was seen, and every score added up by hand."""
    from bisect import bisect_right
    from math import exp

    from factloom.llm.quality_gam import feature_rows, train

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = op8_quality(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 500 and auc(held) > 0.95
    for label in (0, 1):
        own = [(s >= 0.3) == bool(y) for s, y in held if y == label]
        assert sum(own) / len(own) > 0.85, label
    low, high = [[y for s, y in held if inside(s)] for inside in (lambda s: s < 0.2, lambda s: s > 0.8)]
    assert sum(low) / len(low) < 0.2 and sum(high) / len(high) > 0.9
    model, text = train(feature_rows(docs), labels), {r.doc_id: r.text or "" for r in docs.limit(300).collect()}
    for r in rows:
        if r.doc_id in text:
            x = features(text[r.doc_id])
            at = [bisect_right(e.tolist(), v) for e, v in zip(model.edges, x, strict=True)]
            total = model.base + sum(t[i] for t, i in zip(model.tables, at, strict=True)) + sum(t[at[f], at[g]] for f, g, t in model.pairs)
            assert abs(1 / (1 + exp(-total)) - r.score) < 1e-9


def test_keep_good_keeps_odd_rows(spark, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    score = {(r.doc_id, r.predicted) for r in op8_quality(odd, labels).collect()}
    kept = keep_good(odd, labels)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {i for i, p in score if p}
    assert keep_good(none, labels).columns == none.columns and keep_good(none, labels).count() == 0
    assert keep_good(odd, labels.limit(0)).count() == odd.count()


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert len(features("")) == len(features("a b\nc"))


# --- WebP: a small writer with everything that the reader must undo ------------------------------------------------------
class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value, n):
        self.value |= value << self.n
        self.n += n

    def code(self, lengths, symbol):
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if len(used) == 1:
            return
        code, last = 0, used[0][0]
        for n, s in used:
            code <<= n - last
            last = n
            if s == symbol:
                for k in range(n - 1, -1, -1):
                    self.put(code >> k & 1, 1)
                return
            code += 1

    def bytes(self):
        return self.value.to_bytes(-(-self.n // 8), "little")


def lengths_for(symbols, alphabet):
    """A complete code over the symbols used: lengths k or k + 1, so codes differ in length."""
    used = sorted(set(symbols)) or [0]
    out = [0] * alphabet
    if len(used) == 1:
        out[used[0]] = 1
        return out
    k = len(used).bit_length() - 1
    short = (2 << k) - len(used)
    for i, s in enumerate(used):
        out[s] = k if i < short else k + 1
    return out


def put_code(w, lengths):
    w.put(0, 1)
    used = sorted(set(lengths))
    own = [0] * 19
    for s, n in zip(range(19), lengths_for(used, 19)):
        own[s] = n
    order = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
    w.put(15, 4)
    for s in order:
        w.put(own[s], 3)
    w.put(0, 1)
    for n in lengths:
        w.code(own, n)


def put_image(w, argb, width, main, cache_bits=0, references=False, group_bits=0):
    """Literals, back-references to equal runs, and the colour cache."""
    argb = [int(v) for v in argb]
    w.put(1, 1) if cache_bits else w.put(0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    items, at, cache, seen = [], 0, {}, 0
    while at < len(argb):
        best = 0
        if references:
            for distance in (1, width, width + 1, 200):
                n = 0
                while distance <= at and at + n < len(argb) and n < 300 and argb[at + n] == argb[at + n - distance]:
                    n += 1
                if n > best:
                    best, far = n, distance
        while seen < at:
            cache[(0x1E35A7BD * argb[seen] & 0xFFFFFFFF) >> (32 - cache_bits)] = argb[seen] if cache_bits else None
            seen += 1
        slot = (0x1E35A7BD * argb[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if best >= 3:
            items.append(("copy", best, {1: 2, width: 1}.get(far, far + 120)))
            at += best
        elif cache_bits and cache.get(slot) == argb[at]:
            items.append(("cache", slot))
            at += 1
        else:
            items.append(("pixel", argb[at]))
            at += 1

    def prefix(v):
        if v <= 4:
            return v - 1, 0, 0
        k = (v - 1).bit_length() - 2
        half = (v - 1) >> k & 1
        return 2 * k + 2 + half, k, v - 1 - (2 + half << k)

    across = -(-width >> group_bits) if group_bits else 1
    place, spots = 0, []
    for item in items:
        spots.append(((place // width >> group_bits) * across + (place % width >> group_bits)) % 2 if group_bits else 0)
        place += item[1] if item[0] == "copy" else 1
    if main:
        w.put(1 if group_bits else 0, 1)
        if group_bits:
            w.put(group_bits - 2, 3)
            down = -(-(len(argb) // width) >> group_bits)
            put_image(w, [(k % 2) << 8 for k in range(across * down)], across, False)
    streams = [[[], [], [], [], []] for _ in range(1 + (group_bits > 0))]
    for item, g in zip(items, spots):
        s = streams[g]
        if item[0] == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                s[k].append(item[1] >> shift & 255)
        elif item[0] == "copy":
            s[0].append(256 + prefix(item[1])[0])
            s[4].append(prefix(item[2])[0])
        else:
            s[0].append(280 + item[1])
    codes = [[lengths_for(x, n) for x, n in zip(s, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40))] for s in streams]
    for group in codes:
        for lengths in group:
            put_code(w, lengths)
    for item, g in zip(items, spots):
        c = codes[g]
        if item[0] == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                w.code(c[k], item[1] >> shift & 255)
        elif item[0] == "copy":
            for value, code, base in ((item[1], c[0], 256), (item[2], c[4], 0)):
                p, n, extra = prefix(value)
                w.code(code, base + p)
                w.put(extra, n)
        else:
            w.code(c[0], 280 + item[1])


def head(width, height):
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    return w


def riff(stream):
    stream += b"\0" * (len(stream) & 1)
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def picture(width, height, seed, colours=0):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.integers(0, 1 << 32, colours, np.uint32)[rng.integers(0, colours, (height, width))]
    return np.repeat(rng.integers(0, 1 << 32, (height, -(-width // 3)), np.uint32), 3, 1)[:, :width].copy()


def as_bgra(argb):
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4)


@pytest.mark.parametrize("options", [{}, {"cache_bits": 3}, {"references": True}, {"cache_bits": 11, "references": True}, {"group_bits": 2}, {"group_bits": 2, "references": True, "cache_bits": 4}])
def test_prefix_codes_references_and_cache(options):
    for seed, (width, height) in enumerate([(1, 1), (7, 5), (33, 20)]):
        argb = picture(width, height, seed)
        w = head(width, height)
        w.put(0, 1)
        put_image(w, argb.ravel(), width, True, **options)
        assert (decode(riff(w.bytes())) == as_bgra(argb)).all()


def predicted(p, y, x, mode):
    """The prediction as the format defines it, pixel by pixel."""
    at = lambda yy, xx: p[yy, xx].astype(int)
    if y == 0 and x == 0:
        return np.array([0, 0, 0, 255])
    if y == 0:
        return at(0, x - 1)
    if x == 0:
        return at(y - 1, 0)
    left, top, corner = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
    right = at(y - 1, x + 1) if x + 1 < p.shape[1] else at(y, 0)
    mean = lambda a, b: (a + b) // 2
    if mode == 11:
        guess = left + top - corner
        return left if abs(guess - left).sum() < abs(guess - top).sum() else top
    half = mean(left, top)
    return [np.array([0, 0, 0, 255]), left, top, right, corner, mean(mean(left, right), top), mean(left, corner), half, mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right)), None, np.clip(left + top - corner, 0, 255), np.clip(half + np.trunc((half - corner) / 2).astype(int), 0, 255), np.array([0, 0, 0, 255]), np.array([0, 0, 0, 255])][mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height = 13, 9
    argb = picture(width, height, mode)
    p = as_bgra(argb)
    residue = np.array([[(p[y, x].astype(int) - predicted(p, y, x, mode if (x >> 2) % 2 == 0 else 13 - mode)) % 256 for x in range(width)] for y in range(height)], np.uint8)
    w = head(width, height)
    w.put(1, 1)
    w.put(0, 2)
    w.put(0, 3)
    across, down = -(-width // 4), -(-height // 4)
    put_image(w, [(mode if k % across % 2 == 0 else 13 - mode) << 8 for k in range(across * down)], across, False)
    w.put(0, 1)
    put_image(w, np.ascontiguousarray(residue).view("<u4").ravel(), width, True)
    assert (decode(riff(w.bytes())) == p).all()


def test_cross_colour_and_green():
    width, height = 11, 6
    argb = picture(width, height, 3)
    p = as_bgra(argb).copy()
    element = (250, 17, 200)  # green to red, green to blue, red to blue
    s = [int(np.uint8(e).view(np.int8)) for e in element]
    q = p.copy()
    signed = lambda c: c.view(np.int8).astype(int)
    green, red = signed(np.ascontiguousarray(p[..., 1])), signed(np.ascontiguousarray(p[..., 2]))
    q[..., 2] = (p[..., 2] - (s[0] * green >> 5)) % 256
    q[..., 0] = (p[..., 0] - (s[1] * green >> 5) - (s[2] * red >> 5)) % 256
    q[..., 0] -= q[..., 1]
    q[..., 2] -= q[..., 1]
    w = head(width, height)
    w.put(1, 1)
    w.put(1, 2)
    w.put(1, 3)
    put_image(w, [element[2] << 16 | element[1] << 8 | element[0]] * 2, 2, False)
    w.put(1, 1)
    w.put(2, 2)
    w.put(0, 1)
    put_image(w, np.ascontiguousarray(q).view("<u4").ravel(), width, True)
    assert (decode(riff(w.bytes())) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 40])
def test_palettes(colours):
    width, height = 13, 4
    argb = picture(width, height, colours, colours)
    table, index = np.unique(argb, return_inverse=True)
    index = index.reshape(height, width)
    bits = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    each, per = 8 >> bits, 1 << bits
    wide = -(-width // per)
    packed = np.zeros((height, wide), int)
    for x in range(width):
        packed[:, x // per] |= index[:, x] << (x % per * each)
    w = head(width, height)
    w.put(1, 1)
    w.put(3, 2)
    w.put(len(table) - 1, 8)
    steps = np.diff(as_bgra(table[None])[0].astype(int), axis=0, prepend=np.zeros((1, 4), int)) % 256
    put_image(w, np.ascontiguousarray(steps.astype(np.uint8)).view("<u4").ravel(), len(table), False)
    w.put(0, 1)
    put_image(w, (packed << 8).ravel(), wide, True)
    assert (decode(riff(w.bytes())) == as_bgra(argb)).all()


def test_bad_streams_are_refused():
    with pytest.raises(ValueError):
        decode(b"RIFF")
    whole = pack(b"abc" * 64)
    with pytest.raises(ValueError):
        decode(whole[:4] + whole[4:8] + whole[8:60])
    assert Bits(b"\x05").read(3) == 5


def test_store_is_lossless():
    for x in [b"\0" * 64, b"ab" * 32, b"abc d" * 64, os.urandom(64 * 40), bytes(range(256)), os.urandom(64 * 16384 + 192), b"x" * (64 * 20000)]:
        assert restore(store(x)) == x


SAMPLES = [b"the quick brown fox jumps " * 90, "añoüé 日本語 и так".encode() * 60, bytes(i * 3 % 256 for i in range(9999)), b"abcdefgh" + b"z" * 9000 + b"abcdefgh", bytes(range(256)) * 9, b"-".join(str(i * i).encode() for i in range(4000))]


def test_stored_images_use_references_and_predictor_and_shrink():
    from factloom.llm import webp

    kinds = {k: [] for k in ("references", "left", "palette")}
    for x in [*SAMPLES, b"ab" * 400]:
        samples = np.frombuffer(x, np.uint8)
        kinds["references"].append(bool(webp.references(samples)))
        stream = dict((n, c) for n, c, _ in webp.chunks(store(x)))[b"VP8L"]
        bits = Bits(stream)
        bits.read(40)
        kind = bits.read(2) if bits.read(1) else None
        kinds["left"].append(kind == webp.PREDICTOR)
        kinds["palette"].append(kind == webp.PALETTE)
        assert restore(store(x)) == x and len(store(x)) < len(x)
    assert all(any(v) for v in kinds.values())


def test_walking_and_looping_decoders_agree(monkeypatch):
    from factloom.llm import webp

    rng = random.Random(7)
    noisy = [bytes(rng.choice(b"etaoin shrdlu\n") if rng.random() < 0.95 else rng.randrange(256) for _ in range(rng.randint(1, 3000))) for _ in range(20)]
    stored = [store(x) for x in [*SAMPLES, *noisy]]
    walked = [decode(m) for m in stored]
    monkeypatch.setattr(webp, "WINDOW", 7)
    assert all((decode(m) == w).all() for m, w in zip(stored[5:12], walked[5:12], strict=True))
    monkeypatch.setattr(webp, "_read_green", lambda bits, group, n, width: webp._read_any(bits, [group], None, 0, 0, n, width))
    assert all((decode(m) == w).all() for m, w in zip(stored, walked, strict=True))
    assert [restore(m) for m in stored] == [*SAMPLES, *noisy]


def test_lengths_and_distances_have_their_prefixes():
    from factloom.llm.webp import _count, prefixed

    values = np.array([*range(1, 300), 4096, 4097, 1 << 19, (1 << 20) - 1])
    for v, symbol, extra, wide in zip(values.tolist(), *(x.tolist() for x in prefixed(values)), strict=True):
        assert _count(Bits(extra.to_bytes(5, "little")), symbol) == v and extra < 1 << wide


def test_op9(odd, none):
    got = op9_webp(odd).collect()
    want = Counter()
    for r in odd.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        media = store(payload)
        p = Counter(payload)
        bits = sum(n * math.log2(len(payload) / n) for n in p.values()) / len(payload)
        shape = f"64x{len(payload) // 64};mean={sum(payload) * 1000 // len(payload)};distinct={len(p)};entropy={round(bits * 1000)}"
        want[r.doc_id, len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha256(media).hexdigest(), shape] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == want
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert op9_webp(none).count() == 0
