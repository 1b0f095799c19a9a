"""Phrases against plain counts, with many small chunks and ranges."""

import collections
import random
import re

import numpy as np
import pytest

from roomtable.llm import collocations

DOCS = "doc_id long, text string, lang string, key string, f long, part int, rank long, word string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", 1, 2, 3, "w") for i, (t, lang) in enumerate(rows)], DOCS)


def plain(rows, least, top):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts[lang or "und"][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = {p[i:j] for p, a in kept.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * f[p[i:j]]}
        found = []
        for p, a in kept.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed, docs, vocabulary):
    rng = random.Random(seed)
    words = [*(f"w{k}" for k in range(vocabulary)), "The", "the", "É", "é", "a\x01", "a", "a\x1cb", " x"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ", " ", " ", " "]
    fixed = " ".join(rng.choice(words) for _ in range(12))
    texts = [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 80))) + (fixed if rng.random() < 0.3 else ""), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(docs)]
    return [*texts, (None, "en"), ("", None), (None, None), (" \t", "de"), texts[0], texts[0]]


@pytest.mark.parametrize("least, top, chunk_words, range_words, common", [(3, 50, 10_000, 10_000, 1000), (2, 2000, 37, 60, 10), (5, 7, 6, 25, 1)])
def test_phrases_equal_plain_counts(spark, least, top, chunk_words, range_words, common):
    """Many small chunks and ranges; with few common words the others' numbers are joined in."""
    rows = made(least, 80, 9)
    found = collocations.collocations(table_of(spark, rows), least, top, chunk_words, range_words, common)
    assert rows_of(found) == plain(rows, least, top)


def test_one_long_text_of_one_piece_is_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_SLICE", 50)
    rng = random.Random(8)
    rows = [(" ".join(rng.choice("abcd") for _ in range(3000)), "en"), ("x" * 500, "en"), ("so on " * 400, "en")]
    plainly = collocations._slices((rows[0][0] + " ").encode())
    assert b"".join(plainly) == (rows[0][0] + " ").encode()
    assert rows_of(collocations.collocations(table_of(spark, rows), 10, 500, 100, 300)) == plain(rows, 10, 500)


def test_no_rows_and_nothing_frequent(spark):
    assert collocations.collocations(table_of(spark, [])).count() == 0
    assert collocations.collocations(table_of(spark, [("one two three", "en"), (None, None)])).count() == 0


def test_scores_past_64_bits_are_exact(spark):
    big = 4_000_000_007 * 1_000
    row = spark.createDataFrame([(big, big * 999, [big + 1], [big + 3])], "a long, n long, heads array<long>, tails array<long>")
    assert row.selectExpr(f"{collocations.EXACT} AS s").first()["s"] == [1000 * big * big * 999 // ((big + 1) * (big + 3))]


def test_chains_and_window_order():
    keys = sorted(np.array(x, ">u4").tobytes() for x in ([1], [1, 2], [1, 2, 3], [1, 3], [2], [256], [256, 1]))
    assert [len(c) for c in collocations.chains(keys, [1] * 7)] == [0, 1, 2, 1, 0, 0, 1]
    rng = np.random.default_rng(2)
    for top in (4, 2**17, 2**30):
        columns = collocations.windows(rng.integers(0, top, 500).astype(np.uint32), 490)
        columns = columns[:, collocations.in_order(columns)]
        assert [*zip(*columns.tolist(), strict=True)] == sorted(zip(*columns.tolist(), strict=True))
        assert (np.sort(collocations._as_keys(columns)) == collocations._as_keys(columns)).all()
        assert (collocations._unpacked(collocations._packed(columns, columns[0]), columns.shape[1])[:5] == columns).all()
