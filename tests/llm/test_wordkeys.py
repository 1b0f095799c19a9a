"""Words and keys of many texts at a time, against plain splitting and counting."""

import collections
import random
import re
import time

import numpy as np
import xxhash

from roomtable.llm import backoff
from roomtable.llm.wordkeys import Words, grouped, pieces

ODD = ["", " \n\t ", "A a\x00 a b", "é É ß\x85x \x1c y", "x" * 9 + " " + "x" * 8 + "\x00", "the the", "q" * 600 + " " + "q" * 601 + " Q" + "q" * 599, "\x0b\x0c\r", "tail "]


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_token_keys_part_words_as_plain_splitting_does(monkeypatch):
    rng = random.Random(21)
    texts = ODD + ["".join(rng.choice("abAB \n\x00é") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    monkeypatch.setattr("roomtable.llm.wordkeys.PIECE", 500)
    data = [t.encode() for t in texts]
    assert [t for some in pieces(data) for t in some] == data
    keys, sizes = backoff.token_keys(data)
    want = [w for t in texts for w in [*plain_words(t), None]]
    assert sizes.tolist() == [len(plain_words(t)) + 1 for t in texts] and len(keys) == len(want)
    assert all((k == backoff.END) == (w is None) for k, w in zip(keys.tolist(), want, strict=True))
    assert len(set(zip(keys.tolist(), want, strict=True))) == len(set(keys.tolist())) == len(set(want))
    assert [len(x) for x in backoff.token_keys([])] == [0, 0]


def test_groups_and_tallies_equal_counting():
    rng = np.random.default_rng(22)
    keys = (rng.integers(0, 300, 5000, dtype=np.uint64) << np.uint64(40)) | np.uint64(1)
    known = rng.random(5000) < 0.7
    place, number = grouped(keys)
    assert np.array_equal(keys[place][number], keys) and np.array_equal(keys[place], np.unique(keys))
    distinct, own = backoff._tally(backoff._marked(keys, known), 1)
    count = collections.Counter(keys[known].tolist())
    assert np.array_equal(distinct, np.unique(keys)) and own.tolist() == [count[k] for k in distinct.tolist()]


def test_keys_of_many_different_words_cost_less_than_one_hash_each():
    text = " ".join(f"word{k}" for k in range(400_000)).encode()

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    assert len(np.unique(Words([text]).keys())) == 400_000
    one_by_one = min(seconds(lambda: [xxhash.xxh64_intdigest(w) | 1 for w in text.split()]) for _ in range(3))
    assert min(seconds(lambda: backoff.token_keys([text])) for _ in range(3)) < one_by_one


def test_many_texts_are_encoded_as_the_library_does(monkeypatch):
    """Words met before are not asked for one by one, and words may crowd out others, there and in the memory."""
    from tokenizers import Tokenizer

    from roomtable.llm import subwords

    path = subwords.vocabulary_path()
    plain = Tokenizer.from_file(path)
    asked = collections.Counter()

    class Asked(subwords._Memory):
        def __getitem__(self, word):
            asked[word] += 1
            return super().__getitem__(word)

    rng = random.Random(23)
    marks = ["Stone, floor: wood; oak.", "it's, l'été, (so), x). a.b, a,b <|endoftext|>, é, n.\n\nz!", ",", "a,", "é, a?\tb.", "a", "a\x00", "ẞİ."]
    texts = ODD + marks + ["".join(rng.choice([*"ab.,A é\n", "word, ", "<|endoftext|>"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    memory = Asked(path)
    monkeypatch.setattr(subwords, "_memory", lambda path: memory)
    encode = subwords.texts_encoder.__wrapped__(path)
    assert [x.tolist() for x in encode([t.encode() for t in texts])] == want
    asked.clear()
    assert len(list(encode([b"stone stone oak, stone"] * 1000))) == 1000
    asked.clear()
    assert len(list(encode([b"stone stone oak, stone"] * 1000))) == 1000
    assert not asked
    monkeypatch.setattr(subwords, "REMEMBERED", 40)
    monkeypatch.setattr("roomtable.llm.wordkeys.PIECE", 300)
    many = [t.encode() for t in texts] + [f"stone plank{k} " .encode() * 9 for k in range(200)]
    assert [x.tolist() for x in encode(many)][: len(want)] == want
    assert len(memory) + len(memory.older) < 600 and b"plank1" not in {**memory, **memory.older}
    for bits in (1, 4):
        monkeypatch.setattr(subwords, "SLOT_BITS", bits)
        crowded = subwords.texts_encoder.__wrapped__(path)
        for _ in range(2):
            assert [x.tolist() for x in crowded([t.encode() for t in texts])] == want
