"""Training-data operators against brute force, on small fixtures with nulls, ties, copies and empty tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

import corpus_pipeline  # noqa: E402

from quadrat.llm import crf, decontam, jaccard, lines, lm, mixing, passages, queries, rules, sharding, styletree  # noqa: E402
from quadrat.llm.graph import components  # noqa: E402
from quadrat.llm.words import word_hashes  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string"


def lowered(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


@pytest.fixture(scope="module", autouse=True)
def _importable(spark):
    queries.importable(spark)


def invented(seed, n, vocabulary=200, longest=60):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_words():
    texts = ["", None, "  A b\t", "x" * 100 + " " + "x" * 101, "Éa ÉA éa", "a\x0bb\x1cc", " "]
    hashes, bounds = word_hashes(texts)
    names = {}
    for i, t in enumerate(texts):
        own = lowered(t)
        assert len(own) == bounds[i + 1] - bounds[i]
        for w, h in zip(own, hashes[bounds[i] : bounds[i + 1]], strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def joined_up(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 20)] + [(50, 51)], []])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == joined_up(edges)


def jaccard_groups(rows):
    sets = {}
    for i, t in rows:
        w = lowered(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    edges = [(i, i) for i in sets]
    edges += [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    parts = joined_up(edges)
    return {i: (len(s), parts[i]) for i, s in sets.items()}


@pytest.mark.parametrize("turns", [0, 1, 4])
def test_jaccard_families_of_near_copies(spark, turns):
    rng, rows = random.Random(5), []
    for family in range(2):
        base = [f"f{family}w{i}" for i in range(70)]
        for i in range(60):
            own = list(base)
            for _ in range(rng.randrange(1, 4)):
                own[rng.randrange(70)] = f"x{family}y{i}z{rng.random()}"
            rows.append((1000 * family + i, " ".join(own)))
    want = jaccard_groups(rows)
    assert len({c for _, c in want.values()}) > 2
    got = jaccard.grouped(spark.createDataFrame(rows, DOC), turns=turns)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want


def test_jaccard_keys_shared_by_links():
    """Sets that link share as many keys as the rule says, whatever the order of shingles."""
    rng, rule = np.random.default_rng(6), jaccard.Rule()
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        lost, added = (int(rng.integers(0, n // 8 + 2)) for _ in range(2))
        order = rng.permutation(n + added)
        a, b = order[:n], order[min(lost, n - 1) :]
        a, b = np.sort(a), np.sort(b)
        if not rule.links(len(np.intersect1d(a, b)), len(a), len(b)):
            continue
        shared = len(np.intersect1d(a[: rule.prefix(len(a))], b[: rule.prefix(len(b))]))
        assert shared >= max(rule.shared(len(a)), rule.shared(len(b)))


def test_jaccard_with_a_common_passage(spark):
    """Texts of several families that quote parts of one passage, some of them cut short."""
    rng, rows = random.Random(11), []
    passage = [f"p{i}" for i in range(40)]
    for family in range(12):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice([30, 70, 150]))]
        for _ in range(rng.choice([1, 3, 25])):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            if rng.random() < 0.4:
                own[len(own) // 2 : len(own) // 2] = passage[: rng.randrange(40)]
            if rng.random() < 0.2:
                own = own[: int(len(own) * 0.85)]
            rows.append((len(rows), " ".join(own)))
    want = jaccard_groups(rows)
    assert 5 < len({c for _, c in want.values()}) < len(rows)
    assert {r[0]: (r[1], r[2]) for r in jaccard.grouped(spark.createDataFrame(rows, DOC)).collect()} == want


@pytest.mark.parametrize("tile,often", [(2048, 32), (3, 4)])
def test_jaccard(spark, tile, often):
    rng = random.Random(4)
    common, rows = [f"c{k}" for k in range(25)], []
    for family in range(25):
        base = (common if family % 3 == 0 else []) + [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 5, 6, 9, 20, 60]))]
        for _ in range(rng.choice([1, 2, 8])):
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 12)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "Only"), (904, "only")]
    df = spark.createDataFrame(rows, DOC)
    want = jaccard_groups(rows)
    assert {r[0]: (r[1], r[2]) for r in jaccard.grouped(df, tile=tile, often=often).collect()} == want
    if tile > 3:
        twice = df.unionByName(df.where("doc_id = 903"))
        kept = sorted(r.doc_id for r in jaccard.one_of_each(twice).collect())
        assert kept == sorted(i for i, (_, c) in want.items() if i == c)
        assert jaccard.grouped(df.limit(0)).collect() == []


def test_line_dedup(spark):
    rows = [(3, "A common line here\nown three\n a COMMON line here"), (1, "a common line here\nshort\na common line here"), (2, None),
            (5, "short\nÀ common line héré\n"), (6, "À common line héré"), (7, "")]
    keys = {i: [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for i, t in rows}
    holders = {}
    for i, ks in keys.items():
        for k in ks:
            if len(k) >= 10:
                holders.setdefault(k, set()).add(i)
    want = {}
    for i, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys[i], strict=True) if not (len(holders.get(k, ())) > 1 and i != min(holders[k]))]
        want[i] = (len(keys[i]), len(keys[i]) - len(kept), "\n".join(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    df = spark.createDataFrame([(i, t, i * 10**15 if i > 2 else None) for i, t in rows], DOC + ", key long")
    for size in (1 << 20, 0):  # arrays in every task; lines sent to the arrays
        got = lines.deduplicated(df, array_bytes=size, shard_keys=1).collect()
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text, r.kept_sha256) for r in got} == want
        assert {r.doc_id: r.key for r in got} == {i: i * 10**15 if i > 2 else None for i, _ in rows}
    assert lines.deduplicated(df.limit(0)).collect() == []


def test_line_pieces_have_bounded_rows(spark):
    rows = [(i, f"a line that every document has\nsome line of its own {i}\nline shared by a few {i % 300}") for i in range(3000)]
    df = spark.createDataFrame(rows, DOC)
    asked, arrays = lines.dealt(df, lines.repeated_keys(df), 4, "doc_id", "text", 100)
    assert asked.count() == 9000
    assert asked.groupBy("shard", "piece").count().agg({"count": "max"}).first()[0] < 200
    assert arrays.groupBy("shard", "piece").count().agg({"count": "max"}).first()[0] <= 301
    got = [lines.deduplicated(df, array_bytes=b, shard_keys=100, probe_rows=100).collect() for b in (1 << 20, 0)]
    assert sorted(got[0]) == sorted(got[1])


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    numbers = lines.PerfectHash.build(keys)(keys)
    assert sorted(numbers.tolist()) == list(range(len(keys)))


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([2, 4, 5, 6, 9, 11, 12, 20])))) for i in range(15)] + [(99, None)]
    docs = []
    for d in range(60):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(40))]
        item = rng.choice(items[:15])[1].split()
        for _ in range(rng.randrange(4)):
            item[rng.randrange(len(item))] = "Zz"
        at = rng.randrange(len(words) + 1)
        docs.append((d, "\n ".join(words[:at] + [w.upper() for w in item] + words[at:])))
    docs += [(500, None), (501, "")]
    want = {}
    for d, t in docs:
        a = lowered(t)
        for i, u in items:
            b = lowered(u)
            tier = next((x for x in ((12, 2), (8, 1), (5, 0)) if len(b) >= x[0]), None)
            if tier:
                w, k = tier
                found = {}
                for p in range(len(a) - w + 1):
                    for q in range(len(b) - w + 1):
                        e = sum(x == y for x, y in zip(a[p : p + w], b[q : q + w], strict=True))
                        if e >= w - k:
                            found[p] = max(found.get(p, 0), e)
                if found:
                    want[d, i] = (len(found), max(found.values()), w, min(found), max(found) + w - 1)
    df, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    for portion in (10**6, 40):
        got = {(r[0], r[1]): tuple(r[2:]) for r in decontam.overlaps(df, bench, seeds_at_once=portion).collect()}
        assert got == want
    kept = {r.doc_id for r in decontam.decontaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.overlaps(df, bench.limit(0)).collect() == []


def test_language_model(spark):
    rows = [(i, t) for i, t in enumerate(invented(5, 60, 30))] + [(900, None), (901, ""), (902, "zzz ZZZ")]
    texts = [(i, [*lowered(t), None], zlib.crc32(str(i).encode()) % 7) for i, t in rows]

    def counts(keep):
        u, p, c = Counter(), Counter(), Counter()
        for _, t, k in texts:
            if keep(k):
                for v, w in zip(["<s>", *t[:-1]], t, strict=True):
                    u[w] += 1
                    p[v, w] += 1
                    c[v] += 1
        return u, p, c

    u, p, c = counts(lambda k: k != 2)
    ur, pr, cr = counts(lambda k: k not in (2, 3))
    n, v_ = sum(u.values()), len(u)
    ratios = {}
    for _, t, k in texts:
        for v, w in zip(["<s>", *t[:-1]], t, strict=True):
            if k == 3 and cr[v] and u[w]:
                ratios.setdefault(int(math.log2(cr[v])), []).append(pr[v, w] / cr[v] / ((ur[w] + 1) / (sum(ur.values()) + v_ + 1)))
    weight = {}
    for b, r in ratios.items():
        x = 0.5
        for _ in range(60):
            x = min(max(sum(x * q / (x * q + 1 - x) for q in r) / len(r), 1e-6), 1 - 1e-6)
        weight[b] = x
    df = spark.createDataFrame(rows, DOC)
    for size in (10**6, 5):  # vocabulary in tasks; counts by a join
        got = {r[0]: r for r in lm.scored(df, vocabulary=size).collect()}
        assert len(got) == len(rows)
        for i, t, k in texts:
            base = sum(math.log10((u[w] + 1) / (n + v_ + 1)) for w in t)
            score = 0.0
            for v, w in zip(["<s>", *t[:-1]], t, strict=True):
                q = (u[w] + 1) / (n + v_ + 1)
                x = weight.get(int(math.log2(c[v])), 0.5) if c[v] else 0
                score += math.log10(x * (p[v, w] / c[v] if c[v] else 0) + (1 - x) * q)
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k == 2, len(t), sum(u[w] > 0 for w in t), n)
            assert abs(r.base_score - base) < 1e-8 and abs(r.score - score) < 2e-3 * max(1, abs(score))


def test_crf(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i, t in enumerate(invented(2, 150, 500, 80)):
        good = i % 4 > 0
        rows.append((i, t + "\n" + t[::-1] if good else "\n".join("BUY!! " * rng.randrange(1, 9) for _ in range(3))))
        labels.append((i, int(good)))
    rows += [(900, None), (901, "")]
    out = crf.scored(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert held and sum(r.predicted == (r.doc_id % 4 > 0) for r in held) >= 0.95 * len(held)
    none = crf.scored(spark.createDataFrame(rows, DOC), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in none} == {0.5}


def test_crf_marginals():
    unary, links = np.array([0.3, -1.0, 2.0]), np.array([[0.5, -0.2], [0.1, 0.9]])
    paths = {}
    for code in range(8):
        y = [code >> k & 1 for k in range(3)]
        paths[tuple(y)] = math.exp(sum(u * l for u, l in zip(unary, y, strict=True)) + sum(links[a, b] for a, b in zip(y, y[1:], strict=False)))
    want = [sum(s for y, s in paths.items() if y[k]) / sum(paths.values()) for k in range(3)]
    got, _ = crf.marginals(unary, links, np.array([0, 3]))
    assert np.allclose(got, want)


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 60, 6)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        values, least = rng.integers(0, 2**63, bounds[-1]).astype(np.uint64), int(rng.integers(1, 12))
        want, open_ = [], [(int(a), int(b) - 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        while open_:
            a, b = open_.pop()
            if b - a + 1 >= least:
                c = a + int(values[a : b + 1].argmin())
                want.append((a, c, b))
                open_ += [(a, c - 1), (c + 1, b)]
        got = passages.windows(values, bounds[:-1], bounds[1:], least)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


def test_passages(spark):
    rng = random.Random(2)
    word = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    planted, rows, held = [word(k) for k in (50, 60, 90)], [], set()
    for i in range(120):
        words = ["l1 l2 l3 l4 l5 l6 l7 l8 l9"] * (i % 3 == 0) + word(rng.randrange(20, 200))
        if i % 4 == 0:
            p = list(planted[i // 4 % 3])
            if i % 8 == 0:
                p[25] = f"zz{i}"  # one word differs
            words[5:5] = p
            held.add(i)
        rows.append((i, " ".join(words)))
    copy = " ".join(word(80))
    rows += [(1000, copy), (1001, copy.upper()), (2000, None), (2001, ""), (2002, " ".join(word(10)))]
    got = passages.found(spark.createDataFrame(rows, DOC)).collect()
    assert {r.doc_id for r in got} == held | {1000, 1001}
    assert {r.class_id for r in got if r.doc_id >= 1000} == {1000}
    assert all(r.n_words >= 50 and r.n_words == r.last_word - r.first_word + 1 for r in got)


@pytest.mark.parametrize("tile, partners", [(1000, 2), (40, 1)])
def test_passages_of_variants_of_a_template(spark, tile, partners):
    rng = random.Random(1)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    phrases, rows = [fresh(9) for _ in range(12)], []
    for i in range(100):
        body = sum(rng.sample(phrases, 8), [])
        other = list(body)
        other[rng.randrange(25, 45)] = f"zz{i}"
        rows += [(2 * i + k, " ".join(fresh(15) + b + fresh(15))) for k, b in enumerate((body, other))]
    got = passages.found(spark.createDataFrame(rows, DOC), tile=tile, partners=partners).collect()
    classes = {i: {r.class_id for r in got if r.doc_id == i} for i, _ in rows}
    assert all(classes[2 * i] & classes[2 * i + 1] for i in range(100))


def test_passages_with_phrases_repeated_in_the_other_text():
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    cat, p = lambda *x: np.concatenate(x), fresh(70)
    changed = p.copy()
    changed[36] += 1
    earlier = [p[35:40], p[:35], p[20:58], cat(p[35:40], fresh(3), p[10:15])]
    for body in (p, changed):
        for part in earlier:
            for space in (0, 2, 20, 300):
                q = cat(fresh(9), part, fresh(space), body, fresh(9))
                at = 9 + len(part) + space
                got = passages.shared(cat(fresh(4), p, fresh(4)), q, 50, 80)
                assert any(a <= 4 and b >= 74 and c <= at and d >= at + 70 for a, b, c, d, *_ in got), (len(part), space)
    # texts that repeat one line: the same blocks, written out at once or diagonal by diagonal
    line = fresh(7)
    x, y = np.tile(line, 40), cat(fresh(5), np.tile(line, 30), fresh(5))
    want = passages.shared(x, y, 50, 80)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(passages, "EXPANDED", 0)
        assert passages.shared(x, y, 50, 80) == want != []


def test_compact_windows_of_a_long_text_in_few_steps():
    # every place's window reaches to one end of the text: a walk from place to place takes minutes here
    values = np.arange(1 << 16, dtype=np.uint64) << np.uint64(20)
    begun = time.process_time()
    for v in (values, values[::-1].copy()):
        begin, at, end = passages.windows(v, np.array([0]), np.array([len(v)]), 2)
        assert len(at) == len(v) - 1 and (end - begin + 1 == np.arange(2, len(v) + 1)[:: -1 if v[0] < v[1] else 1]).all()
    assert time.process_time() - begun < 5


def test_blocks_follow_the_best_one_before():
    rng = np.random.default_rng(4)
    for spread in (3, 40, 200):
        begin = np.sort(rng.integers(0, 150, 200))
        end, diagonal = begin + rng.integers(1, 12, 200), rng.integers(-spread, spread, 200)
        got_before, got_score = passages._linked(begin.tolist(), end.tolist(), diagonal.tolist())
        score = []
        for k, (b, e, d) in enumerate(zip(begin.tolist(), end.tolist(), diagonal.tolist(), strict=True)):
            best = (e - b, 0, -1)
            for j in {int(diagonal[i]): i for i in range(k)}.values():  # the last block of each diagonal
                stop, off = int(end[j]), int(diagonal[j]) - d
                gain = e - max(b, stop, stop - off)
                if abs(off) <= passages.APART and b - stop <= 11 and b - stop + off <= 11 and gain > 0:
                    sums = score[j] + gain - 0.01 * abs(off)
                    if sums > best[0] or (sums == best[0] and best[2] >= 0 and diagonal[j] < best[1]):
                        best = (sums, int(diagonal[j]), j)
            score.append(best[0])
            assert (got_before[k], got_score[k]) == (best[2], best[0])


def test_passages_compare_no_stretches_twice(spark, monkeypatch):
    rng = random.Random(1)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    phrases, seen, plain = [fresh(9) for _ in range(12)], [], passages.stored
    rows = [(i, " ".join(fresh(15) + sum(rng.sample(phrases, 8), []) + fresh(15))) for i in range(60)]

    def stored(df, name):
        out = plain(df, name)
        if name == "passage-pairs":
            seen.append({(r.p, r.q, r.pa, r.pb, tuple(sorted(r.bands))) for r in out.collect()})
        return out

    monkeypatch.setattr(passages, "stored", stored)
    passages.found(spark.createDataFrame(rows, DOC), partners=1).collect()
    assert len(seen) == 3 and all(seen) and sum(map(len, seen)) == len(set.union(*seen))


def test_passages_compare_alike_windows_of_a_text_once(spark, monkeypatch):
    # texts repeat one line: their windows have few kinds of surroundings, however often they repeat it
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, sizes, plain = fresh(9), [], passages._across

    def across(rows, tile, partners):
        sizes.append(rows.count())
        return plain(rows, tile, partners)

    monkeypatch.setattr(passages, "_across", across)
    part = lambda i: sum((line + fresh(30 + i) for _ in range(3)), []) + line * 40
    rows = [(i, " ".join(sum((part(i) for _ in range(6)), []))) for i in range(6)]
    got = passages.found(spark.createDataFrame(rows, DOC)).collect()
    assert sizes and max(sizes) < 1000
    assert {r.doc_id for r in got} == set(range(6)) and len({r.class_id for r in got}) == 1


def test_passages_in_portions_are_the_same(spark, monkeypatch):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    phrases, names, plain = [fresh(9) for _ in range(12)], [], passages.stored
    rows = [(i, " ".join(fresh(15) + sum(rng.sample(phrases, 8), []) + fresh(15))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + f" zz{i}") for i in range(3)] + [(200, None), (201, ""), (201, rows[0][1]), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, DOC)

    def stored(df, name):
        out = plain(df, name)
        names.append(name)
        return out

    monkeypatch.setattr(passages, "stored", stored)
    want = passages.found(docs, partners=1).collect()
    assert names.count("passage-links") == 3 and names.count("passage-across") == 2
    names.clear()
    monkeypatch.setattr(passages, "ALWAYS", 1)
    got = passages.found(docs, partners=1).collect()
    assert names.count("passage-links") > 6 and names.count("passage-across") > 4
    assert sorted(got) == sorted(want) != []


def test_windows_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    line = word(12)
    rows = [(i, " ".join(word(30) + line * (1 + i % 5) + word(40))) for i in range(40)]
    monkeypatch.setattr(passages, "BLOCKED", 500)
    docs = spark.createDataFrame(rows + rows[:3], DOC).toDF("id", "text").repartition(3)
    blocks = passages._windows(docs, 50, 3, 7).collect()
    windows = set()
    for r in blocks:
        cols = [np.frombuffer(r[x], t).tolist() for x, t in passages._WINDOW.items()]
        assert {k % 2**64 % 7 for k in cols[0]} == {r.part}
        windows |= set(zip(*cols, strict=True))
    want = []
    for key, f, *mine, near in windows:
        same = [(tuple(w[2:6]), w[6]) for w in windows if w[0] == key]
        spots = sorted(s for s, _ in same)
        if spots[0][0] < spots[-1][0]:
            want.append((key, f, *mine, len(spots), spots[0], spots[-1], min(s for s, n in same if n == near)))
    met = passages._meets(spark.createDataFrame(blocks, "part long, " + ", ".join(f"{x} binary" for x in passages._WINDOW))).collect()
    assert want and sorted((*r[:7], *map(tuple, r[7:])) for r in met) == sorted(want)


def test_quality_rules(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "a b c a b c", "x\nx\n\n \n x\ny x", "#a $b |c| d d d d", "one"] + invented(7, 60, 20, 90))]
    rows += [(1000 + i, "Junk### " * (60 + i)) for i in range(30)] + [(2000 + i, t) for i, t in enumerate(invented(8, 60, 5000, 200))]
    labels = [(i, 0) for i, _ in rows if 1000 <= i < 2000] + [(i, 1) for i, _ in rows if i >= 2000]
    out = rules.judged(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    texts = dict(rows)
    for r in out:
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        real = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(real) - len(set(real)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.base_failed and r.kept)
        if r.doc_id >= 2000:
            assert r.kept == (not r.base_failed)
    bare = rules.judged(spark.createDataFrame(rows, DOC), spark.createDataFrame([], "doc_id long, quality int"), prefix="q_")
    assert all(r.q_kept == (not r.q_base_failed) for r in bare.collect())


def test_mixing(spark):
    rows = [(i, [None, "b", "a", "c"][i % 4], t) for i, t in enumerate(invented(9, 80))] + [(500, "d", None), (501, "a", ""), (3, "c", "again here")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.with_taken(df, range_rows=4).collect()
    size = Counter()
    for _, s, t in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while full := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]:
        for s in full:
            target[s] = 2 * size[s]
        left -= sum(2 * size[s] for s in full)
        open_ -= set(full)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken = Counter()
    for r in out:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(out) == len(rows) and all(taken[s] == math.floor(target[s] + 1e-9) for s in names)
    times = Counter(r.doc_id for r in mixing.mixed(df, range_rows=4).collect())
    assert all(times[r.doc_id] >= (r.taken > 0) for r in out) and max(times.values()) <= 4
    assert mixing.with_taken(df.limit(0)).collect() == []


def test_sharding(spark):
    rows = [(i, t) for i, t in enumerate(invented(10, 150))] + [(1000 + i, "one hot text") for i in range(200)] + [(2000, None), (2001, ""), (2001, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", bundle string")
    out = sharding.sharded(df, 6, grain=20, block_rows=30).collect()
    assert len(out) == len(rows) and {r.bundle for r in out} == {"x"}
    bytes_, slots, homes = Counter(), {}, {}
    for r in out:
        t = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t))
        bytes_[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(r.text or "", set()).add(r.shard)
    assert set(bytes_) == set(range(6)) and max(bytes_.values()) < 1.1 * min(bytes_.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for t, h in homes.items() if t != "one hot text")
    assert sharding.sharded(df.limit(0), 6).collect() == []


def test_best_fit():
    assert sharding.pack([6, 5, 4, 3, 2], 10, 2) == [0, 1, 0, 1, 1]
    assert sharding.pack([6, 6], 10, 1) is None


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a>m</a></nav><div id="sidebar-left">s</div>
<div class="content"><h2>Real &amp; T&eacute;{n}</h2><p>One {n}<br>two<p>three <b>four{n}</p><ul><li>a{n}<li>b{n}</ul></div>
<div class="box"><p>the same on all pages</p></div><section class=comments>zz</section><script>if(a<b){{"</p>"}}</script>
<form>f</form><footer>ft</footer></body></html>"""


def test_site_style_tree(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(n="x" * i)) for i in range(6)] + [(90, None, None), (91, "http://h.example/9", ""), (92, "x", "a < b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (10**6, 0):  # cut nodes in every task; by a join
        got = {r.page_id: r for r in styletree.extracted(df, nodes=size).collect()}
        for i in range(6):
            x = "x" * i
            assert got[i].text == f"Real & Té{x}\nOne {x} two\nthree four{x}\na{x}\nb{x}".replace("One  two", "One two")
            assert got[i].n_chars == len(got[i].text)
        assert (got[90].text, got[91].text, got[92].text) == ("", "", "a < b")


def text_of(source):
    return styletree.main_text(source, None)


@pytest.mark.parametrize(("inside", "stays"), [
    ('<section id="discussion"><p>d</p></section>', "d"), ('<section class="related-work">r</section>', "r"),
    ('<div class="share-price">12</div>', "12"), ('<h2 id="search">S</h2>', "S"), ("<noscript>n</noscript>", "n"),
    ('<table class="comment-counts"><tr><td>3</td></tr></table>', "3"), ("<button>b</button>", "b"), ('<div class="ad">a</div>', ""),
    ('<div class="ads-box">a</div>', ""), ('<section class="comments"><p>c</p></section>', ""), ("<aside>x</aside>", ""),
    ('<div class="cookie-notice">n</div>', ""), ("<form><p>f</p></form>", ""), ("<footer>f</footer>", ""),
])
def test_names_inside_an_article(inside, stays):
    assert text_of(f"<nav>m</nav><article><p>story</p>{inside}</article>") == "\n".join(["story", stays][: 1 + bool(stays)])


def test_forms_and_several_articles():
    assert text_of('<body><form action=x><article><p>a story</p><input value=1></article></form>') == "a story"
    assert text_of("<form><p>the whole page</p></form><p>x</p>") == "the whole page\nx"
    assert text_of("<form><p>search</p></form><p>the story, longer than any form</p>") == "the story, longer than any form"
    assert text_of("<article><p>one</p></article><p>x</p><article><p>two</p></article>") == "one\ntwo"
    assert text_of('<div class="share-page"><article>one</article></div>') == "one"
    assert text_of('<div class="related"><article>tease</article></div><article>real</article>') == "real"


def test_hostile_pages_take_linear_time():
    import time

    sources = [
        "<div " * 10**5, "<b" * 10**5, '<a "> "' * 5 * 10**4, "<a '\">" * 5 * 10**4, "<div>" * 10**5, "<b>" * 10**5 + "<h1></h1>" * 10**4,
        "<div>" * 10**4 + "</x>" * 5 * 10**4, "<i><div>" + "<b>" * 10**4 + "</i>" * 10**4, "<" * 10**5, "<p>t" * 5 * 10**4,
    ]
    start = time.process_time()
    assert text_of(sources[0]) == " ".join(sources[0].split())
    assert time.process_time() - start < 1
    for source in sources:
        text_of(source)
        styletree.page_nodes(source)
    assert time.process_time() - start < 60


def noise_by_hand(pages):
    """Cut nodes and repeated blocks of one host, from the definition, page by page."""
    found = {}
    for source in pages:
        digest, above, styles, contents, plain, hinted = styletree.page_nodes(source)
        if contents:
            found[digest] = (above, styles, contents, plain, hinted)
    m = len(found)
    blocks, shapes, chains, keys, hints = {}, {}, {}, Counter(), set()
    for d, (above, styles, contents, plain, hinted) in found.items():
        hints.update(hinted)
        for c in above:
            chains[c[-1]] = c
        keys.update(plain)
        for node, content in contents:
            blocks.setdefault(node, {}).setdefault(content, set()).add(d)
        for node, style in styles:
            shapes.setdefault(node, {}).setdefault(style, set()).add(d)

    def of(node):
        content = np.mean([1 - math.log(len(p)) / math.log(m) for p in blocks[node].values()])
        counts = np.array([len(p) for p in shapes.get(node, {}).values()] or [1], float)
        shares = counts / counts.sum()
        style = float(-(shares * np.log(shares)).sum() / math.log(m))
        return (styletree.GAMMA * content + (1 - styletree.GAMMA) * style) * (styletree.HINTED if node in hints else 1)

    best = {}
    for node in blocks:
        for up in chains[node]:
            best[up] = max(best.get(up, 0.0), of(node))
    out = {node for node, w in best.items() if w < styletree.NOISE}
    out |= {key for key, k in keys.items() if 1 - math.log(k) / math.log(m) <= styletree.REPEATED}
    return out


STORY = """<body><div class="top"><p>hello</p></div><article><h1>T{n}</h1><p>story {w}</p><p>Sign up for our letter</p>
<div class="share-price">price {w}</div><div class="note-search">find</div><h2>Conclusion</h2><p>end {w}{w}</p></article></body>"""
SHORT = '<body><div class="links"><a>Home</a> <a>News</a> and a very long row of links that outweighs all</div><div class="s"><p>{w}</p></div></body>'


@pytest.mark.parametrize("page", [STORY, SHORT])
def test_importance_by_hand(spark, page):
    words = ["ash", "birch", "cedar", "elm", "fir", "oak", "pine", "yew"]
    pages = [page.format(n=i, w=w) if i % 4 else page.format(n=i, w=w).replace("<h2>Conclusion</h2>", "") for i, w in enumerate(words)]
    pages += pages[:2]  # equal pages are one
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)] + [(50, "http://other.example/", pages[0]), (51, None, pages[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    cut = noise_by_hand(pages)
    found = {(r.host, r.node) for r in styletree.noise(styletree.trees(df, "url", "html")).collect()}
    assert found == {("h.example", n) for n in cut} and found
    for size in (10**6, 0):
        got = {r.page_id: r.text for r in styletree.extracted(df, nodes=size).collect()}
        assert got == {i: styletree.main_text(p, cut if u and "h.ex" in u else None) for i, u, p in rows}
    if page is STORY:  # the repeated plain paragraph goes, a heading of most pages and the rest stay
        assert got[1] == "T1\nstory birch\nprice birch\nConclusion\nend birchbirch"
        assert "Sign up" in got[50] and "Sign up" in got[51]
    else:  # a menu without a name goes, though it is most of the page
        assert got[1] == "birch"


def test_site_style_tree_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, Text string")
    assert styletree.extracted(df.drop("Text")).count() == 0
    with pytest.raises(ValueError, match="exist already"):
        styletree.extracted(df)


def test_pipeline_stages(spark, tables_dir):
    """Every stage keeps the columns of documents; what it drops is what its operator says."""
    docs = spark.read.parquet(f"{tables_dir}/documents.parquet")
    docs = docs.select("*", docs.doc_id.alias("kept"), docs.doc_id.alias("size"))
    kept = corpus_pipeline.quality_rules(spark, docs, tables_dir)
    assert kept.columns == docs.columns
    kept = kept.cache()
    unique = corpus_pipeline.near_duplicates(spark, kept, tables_dir).cache()
    want = jaccard_groups([(r.doc_id, r.text) for r in kept.collect()])
    assert {r.doc_id for r in unique.collect()} == {c for _, c in want.values()}
    clean = corpus_pipeline.benchmark_decontamination(spark, unique, tables_dir).cache()
    assert clean.columns == docs.columns and 0 < clean.count() <= unique.count()
    mixed = corpus_pipeline.source_mixing(spark, clean, tables_dir).cache()
    assert mixed.columns == docs.columns
    last = corpus_pipeline.shards(spark, mixed, tables_dir)
    assert last.count() == mixed.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "source_mixing", "sharding"]
