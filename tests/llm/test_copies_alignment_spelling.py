"""Content sort, token alignment and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

from quadrat.llm import alignment, copies, queries, spelling  # noqa: E402

DOC = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def _importable(spark):
    queries.importable(spark)


# ---------------------------------------------------------------- content sort


def copies_by_hand(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((doc is None, doc, i))
    out = []
    for norm, found in groups.items():
        least = min(found)
        for none, doc, _ in found:
            out.append((doc, least[1], len(found), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str), {(m[1], len(f)) for f in groups.values() if (m := min(f))}


COPIES = [
    (5, "a b"), (3, "a\t\n b"), (9, " a b"), (4, "a b "), (2, ""), (8, None), (None, None), (3, "a b"), (3, "a b"), (7, "A b"),
    (11, "x" * 40 + "1"), (12, "x" * 40 + "2"), (13, "x" * 40 + "1"), (None, "only"), (None, "only"), (20, "é b"), (21, "é b"),
    (30, "long " * 30_000), (29, "long\n" * 30_000),
]


@pytest.mark.parametrize("piece_rows", [1000, 2])
@pytest.mark.parametrize("hot", [0, 300])
def test_copies(spark, piece_rows, hot):
    rows = [*COPIES, *[(1000 - k, "hot \n text") for k in range(hot)], *[(k % 7, "hot too") for k in range(hot)]]
    got = copies.judged(spark.createDataFrame(rows, DOC), piece_rows=piece_rows).collect()
    want, kept = copies_by_hand(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
    stay = [r for r in got if r.kept]
    assert len(stay) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in stay})
    assert all(r.doc_id == r.keep_id for r in stay)


def test_copies_names_and_empty(spark):
    df = spark.createDataFrame([(1, "a", True, "p"), (2, "a", False, "q")], "doc_id long, text string, kept boolean, `Norm.x` string")
    out = copies.judged(df)
    assert out.columns == ["doc_id", "text", "kept", "Norm.x", "keep_id", "group_size", "_kept", "text_sha256"]
    assert {(r.doc_id, r["_kept"], r.kept, r["Norm.x"]) for r in out.collect()} == {(1, True, True, "p"), (2, False, False, "q")}
    assert [r.doc_id for r in copies.deduplicated(df).collect()] == [1]
    assert copies.judged(spark.createDataFrame([], DOC)).count() == 0


def test_copies_largest_task(spark):
    """A text that half of all rows hold is spread over the partitions."""
    df = spark.range(40_000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'same text', concat('t', id)) AS text")
    out = copies.judged(df)
    assert out.where("group_size = 20000").count() == 20_000 and out.where("kept").count() == 20_001
    plan = out._jdf.queryExecution().toString()
    assert "rangepartitioning(head" in plan and "BatchEvalPython" not in plan and "MapIn" not in plan


# ---------------------------------------------------------------- alignment


TEXTS = [
    "Hello world, it's 2024!", "", None, "  two  spaces ", "tabs\tand\nlines\r\n end", "naïve café — ünïcode 漢字 🙂", " ", "\n", "a",
    "<|endoftext|> <s> </s> <unk>", "under▁score", "x  y z \x1c q\x1c", "nul \x00 byte", "we'll 'sss 're  'd", "🙂" * 5,
    "word " * 300, "Hello world, it's 2024!", "<0x41> <0x0A>", "trail   ", "  line \x85 next", "x" * 5000, "don't\n\n  stop   now",
]


def whole_tokens(text):
    """Tokens of the whole text by the two libraries, with the bytes of each."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(alignment.PATH_A)
    first.encode_special_tokens = True
    ids = first.encode(" " + text, add_special_tokens=False).ids
    letters = alignment.byte_letters()
    a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in ids]
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.PATH_B)
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    return a, b


def alignment_by_hand(texts):
    linked, out = [], []
    for text in texts:
        a, b = whole_tokens(text) if text else ([], [])
        wanted = (" " + (text or "")).encode()
        if not text or any(b"".join(t for _, t in side) != wanted for side in (a, b)):
            linked.append(Counter())
            out.append([0, 0, 0, 0, ""])
            continue
        spans = []
        for side in (a, b):
            at, found = 0, []
            for i, t in side:
                found.append((i, at, at + len(t)))
                at += len(t)
            spans.append(found)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        begin, written = 0, []
        for cut in cuts:
            written.append("|".join(",".join(str(i) for i, s, e in side if begin <= s and e <= cut) for side in spans))
            begin = cut
        links = Counter((i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e)
        linked.append(links)
        out.append([len(a), len(b), len(cuts), sum(links.values()), ";".join(written)])
    counts = Counter(p for links in linked for p in links)
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    for row, links in zip(out, linked, strict=True):
        row += [sum(k for p, k in links.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in links.items())]
    return [tuple(r) for r in out]


def invented_texts(n):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "the", "ing", "Ab", "'s", "'", "12", "é", "漢", "🙂", ".", "--", " ", "\x1c", "▁", "un", "Re", "x"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_pieces_spell_whole_texts():
    """Tokens by pieces equal tokens of whole texts."""
    a, b = alignment.byte_level(alignment.PATH_A), alignment.piece_level(alignment.PATH_B)
    for text in [*TEXTS, *invented_texts(400)]:
        if not text or "▁" in text:
            continue
        pieces = alignment.PIECE.findall(" " + text)
        assert "".join(pieces) == " " + text
        want = whole_tokens(text)
        for side, whole in zip((a, b), want, strict=True):
            got = side.of(pieces, [p.encode() for p in pieces])[0].tolist()
            assert got == [i for i, _ in whole], text


@pytest.mark.parametrize("table_pairs", [4_000_000, 40, 0])
def test_alignment(spark, table_pairs):
    texts = [*TEXTS, *invented_texts(60)]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], DOC).repartition(3, "doc_id")
    got = alignment.aligned(df, table_pairs=table_pairs).collect()
    found = Counter((r.text, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in got)
    want = Counter((t, *row) for t, row in zip(texts, alignment_by_hand(texts), strict=True))
    assert found == want
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in got)


def test_alignment_names_and_empty(spark):
    df = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2)], "doc_id long, text string, N_A int")
    out = alignment.aligned(df, keep_text=False, keep_groups=False)
    assert out.columns == ["doc_id", "N_A", "_n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert {(r.N_A, r["_n_a"], r.count_sum) for r in out.collect()} == {(1, 2, 4), (2, 2, 4)}
    assert alignment.aligned(spark.createDataFrame([], DOC)).count() == 0


# ---------------------------------------------------------------- spelling


def words_by_hand(rows):
    out = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near_by_hand(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def forms_by_hand(words):
    near = {w: [v for v in words if near_by_hand(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            top = min(others, key=lambda v: (-words[v], v))
            if words[top] >= 10 * words[w]:
                form[w] = top
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def variant_words(seed, n, letters="abcdé"):
    rng, out = random.Random(seed), {}
    while len(out) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 10, 16, 17, 39, 40, 41, 60])))
        for _ in range(rng.randrange(8)):
            out[word] = rng.choice([2, 3, 25, 30, 300, 300, 4000, 50_000])
            at, what = rng.randrange(len(word)), rng.randrange(3)
            word = word[:at] + rng.choice(letters) * (what < 2) + word[at + (what > 0) :]
            if len(word) < 7:
                break
    return out


@pytest.mark.parametrize(("part_words", "part_queries", "groups"), [(40_000, 400_000, 12), (20, 400_000, 4), (5, 30, 3), (10, 50, 1)])
def test_spelling(spark, part_words, part_queries, groups):
    words = variant_words(part_words, 500)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4, "word")
    got = spelling.grouped(df, groups=groups, part_words=part_words, part_queries=part_queries).collect()
    assert len(got) == len(words)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == forms_by_hand(words)


def test_spelling_chain(spark):
    """Forms of forms lead to the last word, over more steps than one doubling."""
    words = {"a" * (k + 7): 2 * 10**k for k in range(14)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {(r.word, r.root) for r in spelling.grouped(df).collect()} == {(w, "a" * 20) for w in words}


def test_spelling_documents(spark):
    rows = [
        (1, "Straße straßes colouring COLOURING colouring"), (None, "colouring coloring coloring ×÷×÷×÷× ×÷×÷×÷×"), (2, None), (3, ""),
        (1, "Straße straßes colouring COLOURING colouring"), (4, "漢字colouring漢字 Éternité Éternité éternité " + "verylong" * 2000),
        (-5, "colouring_coloring9coloring verbatim " * 40), *[(k, "another different wording colourings") for k in range(100)],
    ]
    got = spelling.variants(spark.createDataFrame(rows, DOC)).collect()
    words = words_by_hand(rows)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == forms_by_hand(words)
    assert len(got) == len(words)
    assert spelling.variants(spark.createDataFrame([], DOC)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None)], DOC)).count() == 0


def test_spelling_matches_brute_force_on_tables(spark, tables_dir):
    docs = spark.read.parquet(f"{tables_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    words = {w: n for w, n in words_by_hand(rows).items()}
    got = {(r.word, r.n) for r in spelling.counted(docs).collect()}
    assert got == set(words.items())


def test_pairs_of_all_words():
    words = sorted(variant_words(9, 300, "ab"))
    seen = np.bincount(np.frombuffer("".join(words).encode("latin-1"), np.uint8), minlength=256)
    for groups in (1, 2, 5):
        w = spelling.Words(pa.array(words), spelling.dealt_letters(seen, groups), groups)
        got = sorted(tuple(sorted(p)) for p in zip(*(x.tolist() for x in spelling.near_pairs(w, w)), strict=True))
        assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near_by_hand(words[i], words[j])]
