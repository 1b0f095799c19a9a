"""Tokens and candidate segments of many regions at once, in arrays.

The texts of a call are joined; a token is a run of letters, of digits or of blanks, or one
other character, and never goes across a region's border. A candidate is a range of tokens
and a kind. Its features are counted from sums over the tokens before it, so a long span
costs no more than a short one; they come as the bits of one number, in the order of NAMES.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 21
#: Names of the features of a span, by bit.
NAMES = (
    "any", "mail", "mail spoken", "quad", "quad in range", "digit groups", "checksum", "fours", "phone shape", "plus", "area",
    "7 digits or fewer", "8 to 15", "16 to 19", "more digits", "no digit", "letters", "own cue", "other cue", "cut left", "cut right",
)
#: Stands between two texts: no character of a region, a cue or a neighbour of a span.
BETWEEN = "\n\n"
_STARTS = 1 << 15  # first tokens whose candidates are made at once

_CUE = re.compile(r"([A-Za-z]{2,12})[.:]{0,2}\x20?$")
_CUES = {
    "email": {"email", "mail", "contact"},
    "ip": {"ip", "host", "server", "address"},
    "card": {"card", "visa", "credit"},
    "phone": {"phone", "tel", "call", "mobile", "fax"},
}
_KIND_OF_CUE = {word: KINDS.index(kind) for kind, words in _CUES.items() for word in words}
_MAIL_SPOKEN = re.compile(r"[A-Za-z0-9._-]+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+|\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]+)+")

_LETTER, _DIGIT, _SPACE, _ALPHA, _ALNUM, _ANY_DIGIT = 1, 2, 4, 8, 16, 32
_EMAIL, _IP, _CARD, _PHONE = range(4)
_BIT = {name: 1 << i for i, name in enumerate(NAMES)}


@dataclass
class Candidates:
    """Tokens by place in the joined text, and candidates by first token, token after the last, kind and features."""

    begin: np.ndarray
    end: np.ndarray
    region: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    kind: np.ndarray
    code: np.ndarray


def _flags_of(x: str) -> int:
    plain = x.isascii()
    return (
        _LETTER * (plain and x.isalpha()) + _DIGIT * (plain and x.isdigit()) + _SPACE * x.isspace() + _ALPHA * x.isalpha() + _ALNUM * x.isalnum() + _ANY_DIGIT * x.isdigit()
    )


@functools.cache
def _table() -> np.ndarray:
    return np.array([_flags_of(chr(i)) for i in range(1 << 16)], np.uint8)


def _flags(points: np.ndarray) -> np.ndarray:
    out = _table()[np.minimum(points, 0xFFFF)]
    if (high := points > 0xFFFF).any():
        found, place = np.unique(points[high], return_inverse=True)
        out[high] = np.array([_flags_of(chr(x)) for x in found], np.uint8)[place]
    return out


def _before(flag: np.ndarray) -> np.ndarray:
    """Sums over what stands before each place, and over all."""
    out = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=out[1:])
    return out


def _next(flag: np.ndarray, none: int) -> np.ndarray:
    """The first place from each one on, and from the end, where the flag holds."""
    out = np.full(len(flag) + 1, none, np.int64)
    out[:-1] = np.where(flag, np.arange(len(flag)), none)
    return np.minimum.accumulate(out[::-1])[::-1]


def _pairs(starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, x) for x from low to high, by start."""
    size = np.maximum(high - low + 1, 0)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(starts, size), np.repeat(low, size) + place


def _shifted(flag: np.ndarray, by: int) -> np.ndarray:
    """The value `by` places on; nothing past the end."""
    out = np.zeros_like(flag)
    if by < len(flag):
        out[: len(flag) - by] = flag[by:]
    return out


class _Tokens:
    """Tokens of the regions (start, end) of a text, in order and apart from each other, with what candidates ask of them."""

    def __init__(self, text: str, regions: np.ndarray):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        flags = _flags(points)
        start, size = regions[:, 0], regions[:, 1] - regions[:, 0]
        shift = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(start - shift, size)
        chars, kinds = points[at], flags[at]
        sort = kinds & (_LETTER | _DIGIT | _SPACE)
        new = np.ones(len(at), bool)
        new[1:] = (sort[1:] != sort[:-1]) | (sort[1:] == 0)
        new[shift] = True
        place = np.flatnonzero(new)
        token = np.cumsum(new) - 1
        self.n = n = len(place)
        self.length = np.diff(np.append(place, len(at)))
        self.begin = at[place]
        self.end = self.begin + self.length
        self.region = np.searchsorted(shift, place, "right") - 1
        self.last = (np.searchsorted(self.region, np.arange(len(regions)), "right") - 1)[self.region]
        sort, head = sort[place], chars[place]
        self.letters, self.digits, blanks = sort == _LETTER, sort == _DIGIT, sort == _SPACE
        other = sort == 0
        sign = {x: other & (head == ord(x)) for x in "@.+()-_%[]"}
        one_blank = blanks & (head == 32) & (self.length == 1)
        first = np.zeros(n, bool)
        first[self.region != np.append(-1, self.region[:-1])] = True

        def within(*flags: np.ndarray) -> np.ndarray:
            """All flags hold, the k-th one k tokens on; the tokens lie in one region."""
            out = self.region == np.append(self.region[len(flags) - 1 :], np.full(min(n, len(flags) - 1), -1))[:n]
            for k, flag in enumerate(flags):
                out = out & _shifted(flag, k)
            return out

        def holding(word: str) -> np.ndarray:
            """Tokens of letters that hold the word in any case."""
            k = len(word) - 1
            hit = token[k:] == token[: len(token) - k]
            for i, x in enumerate(word):
                hit &= (chars[i : len(chars) - k + i] | 32) == ord(x)
            out = np.zeros(n, bool)
            out[token[: len(token) - k][hit]] = True
            return out & self.letters

        self.count = _before(np.where(self.digits, self.length, 0))
        self.dots = _before(sign["."])
        # mails
        at_word = holding("at")
        self.mark = _next(sign["@"] | at_word, n)
        self.point = _next(sign["."] | holding("dot"), n)
        self.ats, self.next_at = _before(sign["@"]), _next(sign["@"], n)
        word = self.letters | self.digits
        self.not_user = _before(~(word | sign["."] | sign["_"] | sign["%"] | sign["+"] | sign["-"]))
        self.not_host = _before(~(word | sign["."] | sign["-"]))
        self.no_label = _before((sign["@"] | sign["."]) & _shifted(sign["."], 1))
        bracketed = at_word & (self.length == 2) & _shifted(sign["]"] | sign[")"], 1)
        bracketed[1:] &= (sign["["] | sign["("])[:-1]
        self.next_spoken = _next(bracketed, n)
        # numbers
        numeric = self.digits | sign["+"] | sign["("] | sign[")"] | sign["."] | sign["-"] | (blanks & (head == 32))
        self.run = _next(~numeric | first, n)[1:] - 1
        self.plus, self.open = sign["+"], sign["("]
        values = np.zeros(n, np.int64)
        short = np.flatnonzero(self.digits & (self.length <= 3))
        for k in range(3):
            longer = short[self.length[short] > k]
            values[longer] = values[longer] * 10 + chars[place[longer] + k] - 48
        part, dot = self.digits & (self.length <= 3), sign["."]
        self.quad = within(part, dot, part, dot, part, dot, part)
        part = part & (values <= 255)
        self.quad_fits = within(part, dot, part, dot, part, dot, part)
        gap = one_blank | sign["-"]
        self.not_group, self.two_gaps = _before(~(self.digits | gap)), _before(gap & _shifted(gap, 1))
        part, gap = self.digits & (self.length == 4), gap | sign["."]
        self.fours = within(part, gap, part, gap, part, gap, part)
        odd = np.zeros(n, bool)
        odd[token[(kinds & _SPACE > 0) & (chars != 32)]] = True
        self.not_phone = _before(sign["+"] | odd)
        self.opens = within(self.plus, self.digits | self.open)
        three, four = self.digits & (self.length == 3), self.digits & (self.length >= 4)
        ends = np.full(n + 1, n, np.int64)
        for shape in ((sign["("], three, sign[")"], three, gap, four), (sign["("], three, sign[")"], one_blank, three, gap, four)):
            hit = np.flatnonzero(within(*shape))
            ends[hit] = hit + len(shape) - 1
        self.area = np.minimum.accumulate(ends[::-1])[::-1]
        # the digits in a row, and sums of those at even and odd places, as they are and doubled
        row = chars[kinds & _DIGIT > 0].astype(np.int64) - 48
        twice = row * 2 - 9 * (row > 4)
        even = np.arange(len(row)) % 2 == 0
        self.checks = [(_before(np.where(side, row, 0)), _before(np.where(side, twice, 0))) for side in (even, ~even)]
        # borders
        alpha = np.zeros(n, bool)
        alpha[other & (kinds[place] & _ALPHA > 0)] = True
        self.alpha = _before(alpha | self.letters)
        far = np.concatenate([[10, 10], points, [10, 10]])
        near = np.concatenate([[0, 0], flags, [0, 0]]).astype(np.uint8)
        left = far[self.begin + 1]
        self.cut_left = (near[self.begin + 1] & _ALNUM > 0) | np.isin(left, [ord(x) for x in "+@._%-"]) | ((left == 32) & (near[self.begin] & _ANY_DIGIT > 0))
        right = far[self.end + 2]
        self.cut_right = (near[self.end + 2] & _ALNUM > 0) | (right == ord("@")) | (np.isin(right, [ord(x) for x in ".- "]) & (near[self.end + 3] & _ANY_DIGIT > 0))

    def checksum(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = self.count[i], self.count[j + 1]
        total = np.zeros(len(i), np.int64)
        for side in (0, 1):
            plain, twice = self.checks[side]
            total += np.where((high - 1) % 2 == side, plain[high] - plain[low], twice[high] - twice[low])
        return total % 10 == 0

    def shared_code(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Features that all kinds may have, of the spans from token i to token j."""
        n = self.count[j + 1] - self.count[i]
        size = np.digitize(n, [1, 8, 16, 20])
        code = np.array([_BIT[x] for x in ("no digit", "7 digits or fewer", "8 to 15", "16 to 19", "more digits")])[size] | _BIT["any"]
        return code | _BIT["area"] * (self.area[i] <= j) | _BIT["cut left"] * self.cut_left[i] | _BIT["cut right"] * self.cut_right[j]

    def numbers(self, i: np.ndarray, limit: np.ndarray):
        """First and last token, kind and features of the numeric candidates that start at the tokens i."""
        low = np.searchsorted(self.count, self.count[i] + 7) - 1
        low = np.where(self.digits[i], np.minimum(low, np.searchsorted(self.dots, self.dots[i] + 3) - 1), low)
        i, j = _pairs(i, np.maximum(low, i), limit)
        keep = self.digits[j]
        i, j = i[keep], j[keep]
        n, head = self.count[j + 1] - self.count[i], self.digits[i]
        kinds = ((_IP, head & (n <= 12) & (self.dots[j + 1] - self.dots[i] == 3)), (_CARD, head & (n >= 12)), (_PHONE, (n >= 7) & (n <= 16)))
        code = self.shared_code(i, j)
        seven = j - i == 6
        groups = head & (self.not_group[j + 1] == self.not_group[i]) & (self.two_gaps[j] == self.two_gaps[i])
        code |= _BIT["quad"] * (seven & self.quad[i]) | _BIT["quad in range"] * (seven & self.quad_fits[i]) | _BIT["digit groups"] * groups | _BIT["fours"] * (seven & self.fours[i])
        some = np.flatnonzero(groups & (n >= 16) & (n <= 19))
        code[some] |= _BIT["checksum"] * self.checksum(i[some], j[some])
        phone = (self.not_phone[j + 1] == self.not_phone[i + 1]) & (~self.plus[i] | self.opens[i])
        code |= _BIT["phone shape"] * phone | _BIT["plus"] * self.plus[i]
        for kind, mask in kinds:
            yield i[mask], j[mask], kind, code[mask]

    def mails(self, i: np.ndarray, low: np.ndarray, limit: np.ndarray, text: str):
        """First and last token, kind and features of the mails that start at the tokens i."""
        i, j = _pairs(i, low, limit)
        keep = self.letters[j] | self.digits[j]
        i, j = i[keep], j[keep]
        code = self.shared_code(i, j) | _BIT["letters"] * (self.alpha[j + 1] > self.alpha[i])
        at = np.minimum(self.next_at[i], j)
        mail = (self.ats[j + 1] - self.ats[i] == 1) & (self.not_user[at] == self.not_user[i]) & (self.not_host[j + 1] == self.not_host[at + 1])
        mail &= (self.dots[j + 1] > self.dots[at]) & (self.no_label[j] == self.no_label[at])
        code |= _BIT["mail"] * mail
        for c in np.flatnonzero(self.next_spoken[i] < j).tolist():
            if _MAIL_SPOKEN.fullmatch(text, int(self.begin[i[c]]), int(self.end[j[c]])):
                code[c] |= _BIT["mail spoken"]
        yield i, j, _EMAIL, code


def candidates(text: str, regions: np.ndarray, lows: np.ndarray) -> Candidates:
    """Candidates of all regions, by first token, last token and kind; lows: where each region's own text starts.

    Those that miss a kind's bare minimum (an '@' or "at" in a mail, three dots in an
    address, digits only in a card) could never score above an outside token.
    """
    t = _Tokens(text, regions)
    made = []
    starts = np.flatnonzero(t.digits | t.plus | t.open)
    limit = np.minimum(t.run[starts], starts + MAX_TOKENS - 1)
    worth = (t.count[limit + 1] - t.count[starts] >= 7) | (t.digits[starts] & (t.dots[limit + 1] - t.dots[starts] >= 3))
    starts, limit = starts[worth], limit[worth]
    for k in range(0, len(starts), _STARTS):
        made += t.numbers(starts[k : k + _STARTS], limit[k : k + _STARTS])
    starts = np.flatnonzero(t.letters | t.digits)
    low = np.maximum(np.maximum(t.mark[starts], t.point[starts]), starts + 1)
    limit = np.minimum(t.last[starts], starts + MAX_TOKENS - 1)
    worth = low <= limit
    starts, low, limit = starts[worth], low[worth], limit[worth]
    for k in range(0, len(starts), _STARTS):
        made += t.mails(starts[k : k + _STARTS], low[k : k + _STARTS], limit[k : k + _STARTS], text)
    first, stop, kind, code = (
        np.concatenate([np.zeros(0, type_), *parts]).astype(type_)
        for type_, parts in (
            (np.int32, [x[0] for x in made]),
            (np.int32, [x[1] + 1 for x in made]),
            (np.int8, [np.full(len(x[0]), x[2], np.int8) for x in made]),
            (np.int32, [x[3] for x in made]),
        )
    )
    cues = np.full(len(regions), -1, np.int8)
    for r in np.unique(t.region[first]).tolist():
        begin = int(regions[r, 0])
        if found := _CUE.search(text[max(int(lows[r]), begin - 16) : begin]):
            cues[r] = _KIND_OF_CUE.get(found[1].lower(), -1)
    cue = cues[t.region[first]]
    code |= np.where(cue == kind, _BIT["own cue"], np.where(cue >= 0, _BIT["other cue"], 0)).astype(np.int32)
    order = np.lexsort((kind, stop, first))
    return Candidates(t.begin, t.end, t.region, first[order], stop[order], kind[order], code[order])
