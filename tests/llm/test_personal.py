"""The array form of the field's candidates against a plain one, and texts that took it long."""

import random
import re
import time

import numpy as np
import pytest

from roomtable.llm import personal, semicrf
from roomtable.llm.spanarrays import _CUE, _CUES, _MAIL_SPOKEN, KINDS, MAX_TOKENS, NAMES

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")
REGION = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*(?:\x20[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*)*")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
GROUPS = re.compile(r"[0-9](?:[ -]?[0-9])*")
FOURS = re.compile(r"[0-9]{4}(?:[ .-][0-9]{4}){3}")
PHONE = re.compile(r"\+?[0-9(][ ().0-9-]*[0-9]")
AREA = re.compile(r"\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}")
ATOMS = [*"a1.@+-( )[]_%2 9%\n", "at", "(at)", "[AT]", "dot", "(dot)", "123", "4567", "(555) 123-4567", "4111 1111 1111 1111", "10.0.0.1", "255.256.1.2", "card ", "phone: "]
ATOMS += ["é", "\xa0", "²", "٣", "😀", "𝟎", "𝐀", "x.y@z.com", "A", "aTdot", "\t", "+1", "0123456789012", "1234-1234-1234-1234", "İ", "\x1c", "ip ", "mail "]


def plain_features(kind, text, start, end, cue):
    span = text[start:end]
    digits = "".join(filter(str.isascii, filter(str.isdigit, span)))
    n = len(digits)
    quad, groups = bool(QUAD.fullmatch(span)), bool(GROUPS.fullmatch(span))
    left, right, after = text[start - 1 : start] if start else "", text[end : end + 1], text[end + 1 : end + 2]
    holds = (
        True, MAIL.fullmatch(span), _MAIL_SPOKEN.fullmatch(span), quad, quad and all(int(x) <= 255 for x in span.split(".")),
        groups, groups and 16 <= n <= 19 and personal.luhn(digits), FOURS.fullmatch(span), PHONE.fullmatch(span), span[0] == "+", AREA.search(span),
        0 < n <= 7, 8 <= n <= 15, 16 <= n <= 19, n > 19, n == 0, any(map(str.isalpha, span)),
        cue in _CUES[kind], any(cue in words for other, words in _CUES.items() if other != kind),
        left.isalnum() or left in set("+@._%-") or text[max(0, start - 2) : start].rstrip("-. ")[-1:].isdigit(),
        right.isalnum() or right == "@" or (right in set(".- ") and after.isdigit()),
    )
    return [i for i, true in enumerate(holds) if true]


def plain_scored(text, region):
    tokens = [m.span() for m in TOKEN.finditer(text, *region)]
    before = _CUE.search(text[max(0, region[0] - 16) : region[0]])
    cue = before[1].lower() if before else ""
    made = []
    for i, (start, _) in enumerate(tokens):
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            end = tokens[j][1]
            span = text[start:end]
            head, tail, heads = span[0], span[-1], [text[s] for s, _ in tokens[i : j + 1]]
            if not (head.isascii() and (head.isalnum() or head in "+(")) or not (tail.isascii() and tail.isalnum()) or j == i and not tail.isdigit():
                continue
            kinds = []
            if head.isalnum() and ("@" in span or "at" in span.lower()) and ("." in span or "dot" in span.lower()):
                kinds.append("email")
            if all(x in "0123456789+(). -" for x in heads) and tail.isdigit():
                digits = sum(map(str.isdigit, span))
                kinds += ["ip"] * (span.count(".") == 3 and head.isdigit() and digits <= 12)
                kinds += ["card"] * (digits >= 12 and head.isdigit())
                kinds += ["phone"] * (7 <= digits <= 16)
            made += [(i, j + 1, kind, plain_features(kind, text, start, end, cue)) for kind in kinds]
    return tokens, made


def plain_spans(text, field):
    """The best segmentation of each whole region, its segments with a posterior of 0.9 and no base span."""
    base, out = personal.base_spans(text), []
    for region in semicrf.regions(text):
        tokens, made = plain_scored(text, region)
        scores = [float(field.weights[KINDS.index(k), f].sum()) for _, _, k, f in made]
        sure, _ = field.posteriors(tokens, made, scores)
        best, choice = [0.0], [-1]
        for j in range(1, len(tokens) + 1):
            value, c = max([(best[-1], -1)] + [(best[x[0]] + scores[c], c) for c, x in enumerate(made) if x[1] == j])
            best.append(value)
            choice.append(c)
        j = len(tokens)
        while j:
            c = choice[j]
            if c >= 0 and sure[c] >= semicrf.CERTAIN:
                start, end = tokens[made[c][0]][0], tokens[made[c][1] - 1][1]
                out += [(made[c][2], start, end)] * all(e <= start or end <= s for _, s, e in base)
            j = made[c][0] if c >= 0 else j - 1
    return sorted(out)


def made_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def plain_regions(text):
    found, out, end = sorted([*(m.span() for m in REGION.finditer(text)), *(m.span() for m in semicrf._AT_WORD.finditer(text))]), [], 0
    for k, (start, stop) in enumerate(found):
        if start >= end:
            end = stop
            for s, e in found[k + 1 : k + 3]:
                end = max(end, e) if s <= end + 1 else end
            out.append((start, end))
    return out


def test_regions_equal_the_patterns():
    for text in made_texts(1500, 6):
        assert list(semicrf.regions(text)) == plain_regions(text)


def test_candidates_and_features_equal_the_plain_ones():
    field = semicrf.Field(np.random.default_rng(1).normal(size=(len(KINDS), len(NAMES))))
    for text in made_texts(250):
        for region in semicrf.regions(text):
            tokens, made, scores = field._scored(text, region)
            assert (tokens, made) == plain_scored(text, region)
            assert scores == pytest.approx([field.weights[KINDS.index(k), f].sum() for _, _, k, f in made])


def test_spans_of_many_texts_equal_those_of_whole_regions():
    texts = made_texts(300, 7) + ["mail bob (at) example.com", "call (415) 555-2671 now", "", "x 12.34.56.78 5551234567"]
    for field in (semicrf.fit([]), semicrf.Field(np.random.default_rng(2).normal(size=(len(KINDS), len(NAMES))))):
        found = [(base, sorted(every[len(base) :])) for base, every in personal.spans_of(texts, field)]
        assert found == [(personal.base_spans(x), plain_spans(x, field)) for x in texts]
        assert any(more for _, more in found)


@pytest.mark.parametrize(
    "text",
    [
        "x " + "7" * 26 + "@mail.example.com",
        "card " + "4111 " * 30 + "at a.b",
        ("a" * 3000 + "@" + "b" * 3000 + "." + "7" * 3000) * 5,
        "12.34.56.78 at.1 " * 4000,
    ],
)
def test_long_and_dense_texts_take_no_long(text):
    """Groups of digits before a mismatch were tried in all ways of cutting them."""
    field = semicrf.fit([])
    start = time.process_time()
    personal.all_spans(text, field)
    assert time.process_time() - start < 8


def test_examples_and_fit_take_dense_regions():
    start = time.process_time()
    texts = [" ".join(f"{a}.{b}.{c}.7" for c in range(20)) for a in range(10) for b in range(10)]
    pieces = [(x, personal.base_spans(x)) for x in texts]
    assert semicrf.fit(pieces).weights.shape == (len(KINDS), len(NAMES))
    assert time.process_time() - start < 60
