"""The filter audit, vector codes and decontamination against plain programs."""

import math
import random
import re
from fractions import Fraction
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest

from logloom.llm import decontaminate, filter_audit, part_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


# ---- filter audit

def failed(rows, i):
    doc_id, text, _ = rows[i]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = ""
    if len(words) < 200:
        found += "A"
    if 100 * len(set(words)) < 50 * len(words):
        found += "B"
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        found += "C"
    if re.search("[#$%&*|]", text):
        found += "D"
    if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text
                                  for d, t, _ in rows):
        found += "E"
    return found


def audited(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = [failed(rows, i) for i in range(len(rows))]
    out, total = {}, {}
    for part in {s or "" for _, _, s in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, x in enumerate(order, 1):
                gone = [i for i in left if x in fails[i]]
                left = [i for i in left if x not in fails[i]]
                all_x = [i for i in mine if x in fails[i]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(all_x) - len(gone),
                    sum(fails[i] == x for i in mine), sum(rows[i][0] in good for i in gone),
                    sum(rows[i][0] in toxic for i in gone)]
                total[part, x] = total.get((part, x), 0) + len(gone)
    return sorted(((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()), key=str)


def documents(spark, rows):
    """With columns named like those of the operators."""
    return spark.createDataFrame(
        [(*r, "a", "b", 1, "c", True) for r in rows],
        "doc_id bigint, text string, source string, mask string, part string, n int, "
        "sha string, good boolean").repartition(5)


def labelled(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows],
                                 "doc_id bigint, quality int, toxic int, n int")


def test_audit(spark):
    draw = random.Random(5)
    texts = [None, "", " ", "x", "x" * 300_000, "É Ñ", "AB c", "a|b", "w " * 250,
             " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i}" for i in range(220)),
             " ".join(f"w{i}" for i in range(199)), " ".join(f"w{i % 100}" for i in range(200)),
             " ".join(f"w{i % 99}" for i in range(200)) + " 100%",
             "\x0b".join(f"w{i}" for i in range(200)), "A" + "b" * 49, "A" + "b" * 48]
    rows = [(draw.choice([None, *range(60)]), draw.choice(texts), draw.choice([None, "", "s", "ß"]))
            for _ in range(150)] + [(100 + i, "same text", "hot") for i in range(80)]
    labels = [(draw.choice([None, *range(150)]), draw.choice([None, 0, 1]), draw.choice([None, 0, 1]))
              for _ in range(90)]
    got = rows_of(filter_audit.audit(documents(spark, rows), labelled(spark, labels)))
    assert got == audited(rows, labels)


def test_audit_of_nothing(spark):
    assert rows_of(filter_audit.audit(documents(spark, []), labelled(spark, []))) == []
    got = rows_of(filter_audit.audit(documents(spark, [(None, None, None)]), labelled(spark, [])))
    assert got == audited([(None, None, None)], [])


@pytest.mark.parametrize("n", [2, 3, 5])
def test_least_squares_are_the_shapley_values(n):
    draw = random.Random(n)
    value = [0] + [draw.randrange(1000) for _ in range((1 << n) - 1)]
    for i, weights in enumerate(filter_audit.shapley_weights(n)):
        total = 0
        for order in permutations(range(n)):
            before = sum(1 << j for j in order[:order.index(i)])
            total += value[before | 1 << i] - value[before]
        assert sum(Fraction(w) * v for w, v in zip(weights, value, strict=True)) == total


# ---- vector codes

def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1]) if kept else 0
    width = length // parts
    fits = [r for r in kept if len(r[1]) == length]
    books = [[v[p * width:(p + 1) * width] for _, v, _ in fits[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in fits:
                part = v[p * width:(p + 1) * width]
                groups.setdefault(nearest(p, part)[1], []).append(part)
            for k, members in groups.items():
                books[p][k] = [sum(x) // len(members) for x in zip(*members)]
    out, by_label = [], {}
    for i, v, label in kept:
        if len(v) != length:
            out.append((i, label, None, None))
            by_label.setdefault(label, 0)
            continue
        found = [nearest(p, v[p * width:(p + 1) * width]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), error))
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((*r, by_label[r[1]]) for r in out), key=str), digest


def embeddings(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", [1]) for r in rows],
        "vec_id bigint, embedding array<float>, label int, code string, ints array<int>"
    ).repartition(4)


def codes_of(spark, rows, **sizes):
    codes, books = part_codes.encode(embeddings(spark, rows), **sizes)
    return rows_of(part_codes.with_label_errors(codes)), part_codes.digest(books)


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_codes(spark, block):
    draw = random.Random(block)
    rows = []
    for i in range(400):
        vector = [np.float32(draw.choice([draw.gauss(0, 0.2), 0.25, -0.001])).item()
                  for _ in range(12)]
        rows.append((draw.choice([None, i, i // 3]), vector, draw.choice([None, 0, 1])))
    rows += [(500 + i, [0.1] * 12, 2) for i in range(200)]
    rows += [(1, None, 0), (2, [None] + [0.0] * 11, 0), (3, [math.nan] * 12, 0),
             (4, [math.inf] + [0.0] * 11, 1)]
    want, digest = plain_codes(rows, 4, 16, 2)
    assert codes_of(spark, rows, parts=4, entries=16, block=block) == (want, digest)


def test_codes_of_few_none_and_odd_vectors(spark):
    rows = [(3, [0.5] * 16, 1), (1, [0.25] * 16, None), (2, [0.5] * 8, 1), (2, [], 4)]
    want, digest = plain_codes(rows, 16, 64, 2)
    assert codes_of(spark, rows) == (want, digest)
    assert codes_of(spark, []) == ([], sha256(b"").hexdigest())
    assert codes_of(spark, [(1, None, 1)]) == ([], sha256(b"").hexdigest())
    with pytest.raises(ValueError, match="equal parts"):
        codes_of(spark, [(1, [0.5] * 15, 1)])


# ---- decontamination

def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def leaked(docs, items, span):
    windows = {}
    for item_id, text in items:
        words = words_of(text)
        n = min(span, len(words))
        for s in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[s:s + n]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        words, hit, owners = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(words) - n + 1):
                if found := windows.get(tuple(words[s:s + n])):
                    hit |= set(range(s, s + n))
                    owners |= found
        spans = [(s, next(e for e in range(s, len(words)) if e + 1 not in hit))
                 for s in sorted(hit) if s - 1 not in hit]
        out.append((doc_id, len(words), len(hit), spans,
                    sorted(str(i) for i in owners if i is not None)))
    return sorted(out, key=str)


def joined_spans(spans):
    """Spans that touch are one."""
    out = []
    for first, last in sorted(spans):
        if out and out[-1][1] + 1 == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def leaks(spark, docs, items, **sizes):
    frame = spark.createDataFrame(
        [(*d, b"k", 1, "w", 5) for d in docs],
        "doc_id bigint, text string, key binary, n_words int, windows string, start int")
    bench = spark.createDataFrame([(*i, "c", 3) for i in items],
                                  "item_id bigint, text string, class string, words int")
    found = decontaminate.contaminated(frame.repartition(4), bench.repartition(2), **sizes)
    return sorted(((d, n, h, joined_spans(tuple(s) for s in spans), i)
                   for d, n, h, spans, i in found.collect()), key=str)


@pytest.mark.parametrize(("span", "gram", "bits"), [(10, 5, 26), (10, 5, 8), (6, 3, 10), (4, 4, 12)])
def test_leaks(spark, span, gram, bits):
    draw = random.Random(span)
    vocabulary = ["the", "The", "café", "ÉCOLE", "x1", "naïve", "b-c", "É|é", "9", "日本", "of", "a"]

    def text(n):
        return draw.choice([" ", "\n", ", "]).join(draw.choice(vocabulary) for _ in range(n))

    items = [(draw.choice([None, *range(12)]), text(draw.choice([0, 4, 9, 10, 11, 40])))
             for _ in range(25)] + [(50, None), (51, "--"), (52, "school"), (7, "zz yy")]
    docs = [(draw.choice([None, *range(30)]), draw.choice([text, lambda n: text(n).upper()])(
        draw.choice([0, 3, 30, 200]))) for _ in range(60)]
    passage = next(t for _, t in items if len(words_of(t)) >= 40)
    docs += [(100 + i, f"{text(i)} {passage} {text(2)}") for i in range(20)]
    docs += [(200, None), (201, "\x00.!"), (202, "word " * 30_000 + passage), (203, "yy zz yy")]
    docs += [(300, passage)] * 40
    assert leaks(spark, docs, items, span=span, gram=gram, bits=bits) == leaked(docs, items, span)


def test_leaks_of_nothing(spark):
    assert leaks(spark, [], [(1, "a b")]) == []
    assert leaks(spark, [(1, "a b"), (2, None)], []) == [(1, 2, 0, [], []), (2, 0, 0, [], [])]
    assert leaks(spark, [(1, "a b")], [(None, "b"), (2, None)]) == [(1, 2, 1, [(1, 1)], [])]


def test_every_shared_span_keeps_a_fingerprint():
    draw = np.random.default_rng(3)
    coded = draw.integers(0, 5, 400).astype(np.uint64)
    [(n, found)] = decontaminate.prints(coded, 10, 5, [])
    grams = decontaminate.gram_hashes(coded, {5})[5].view(np.int64).view(np.uint64)
    assert n == 10 and len(found) == 391
    for s in range(391):
        assert found[s].view(np.uint64) == grams[s:s + 6].min()
