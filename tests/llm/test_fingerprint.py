"""Locally consistent parsing against a parser of plain loops over Python integers, and its properties."""

import random

import numpy as np
import pytest

from ladle.llm import fingerprint

MASK = (1 << 64) - 1
# The multipliers of the names.
K0, K1, K2, K3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93


def scrambled(v):
    v = (v ^ v >> 32) * K3 & MASK
    v = (v ^ v >> 29) * K1 & MASK
    return v ^ v >> 32


def coin(value, before):
    bit = 0
    while value >> bit & 1 == before >> bit & 1:
        bit += 1
    return 2 * bit + (value >> bit & 1)


def cut_stretch(names):
    """A stretch without equal neighbours as phrases."""
    labels = names
    for _ in range(4):
        labels = [coin(v, labels[i - 1] if i else v ^ 1) for i, v in enumerate(labels)]
    phrases = [[names[0]]]
    for i in range(1, len(names)):
        if 2 <= i < len(names) - 1 and labels[i - 1] < labels[i] > labels[i + 1]:
            phrases.append([])
        phrases[-1].append(names[i])
    return phrases


def cut_level(names):
    phrases, stretch, i = [], [], 0
    while i < len(names):
        j = i
        while j < len(names) and names[j] == names[i]:
            j += 1
        if j - i == 1:
            stretch.append(names[i])
        else:
            if stretch:
                phrases += cut_stretch(stretch)
                stretch = []
            while i < j:
                size = 3 if j - i == 3 else 2
                phrases.append(names[i:i + size])
                i += size
        i = j
    return phrases + (cut_stretch(stretch) if stretch else [])


def brute_names(text):
    """All names (level, name) of a text from the lowest level upward, and its own."""
    names, level, out = [scrambled((ord(c) * K2 + K0) & MASK) for c in text], 0, set()
    while names:
        if level >= fingerprint.LOWEST or len(names) == 1:
            out |= {scrambled(v + level & MASK) >> 32 for v in names}
        if len(names) == 1:
            break
        names = [scrambled(sum(scrambled(v + p * K0 & MASK) for p, v in enumerate(ph)) + len(ph) * K2 & MASK)
                 for ph in cut_level(names)]
        level += 1
    return out


def some_texts():
    rng = random.Random(11)
    words = ["lorem", "ipsum", "ssss", "aa", "x", "naïve", "\U0001F600\U0001F600", "\ud800", "moon", "0000000"]
    out = ["", "a", "aa", "aaa", "aaaa", "ab", "aab", "abb", "aabb", "abab" * 9, "a" * 1000, "a" * 1001, " \n" * 50]
    for n in (1, 2, 3, 10, 100, 399, 400, 1500, 3000):
        out.append(" ".join(rng.choice(words) for _ in range(n)))
        out.append("".join(rng.choice("ab") for _ in range(n)))
        out.append("".join(chr(rng.randrange(32, 0xD800)) for _ in range(n)))
    return out


def test_sketches_equal_the_plain_parser():
    texts = some_texts()
    together = fingerprint.sketches(texts)
    for t, got in zip(texts, together):
        assert got.tolist() == sorted(brute_names(t))[:fingerprint.SKETCH], t[:40]
        assert np.array_equal(got, fingerprint.sketches([t])[0])  # neighbours in the batch do not matter


def test_likeness_follows_the_plain_sets():
    texts = [t for t in some_texts() if len(t) > 300]
    got = fingerprint.sketches(texts)
    for i, t in enumerate(texts):
        edited = fingerprint.edited_text(t, texts[i - 1])
        a, b = brute_names(t), brute_names(edited)
        near = fingerprint.likeness(got[i], fingerprint.sketches([edited])[0])
        assert abs(near - len(a & b) / len(a | b)) < 0.25


@pytest.mark.parametrize("n", [150, 399, 400, 1499, 1500, 9000])
def test_one_changed_character_costs_little_at_every_length(n):
    rng = random.Random(n)
    for _ in range(10):
        t = "".join(rng.choice("abcdefgh ") for _ in range(n))
        at = rng.randrange(n)
        a, b, c = fingerprint.sketches([t, t[:at] + "#" + t[at + 1:], t[:at] + t[at + 1:]])
        least = 0.4 if n < 300 else 0.65
        assert fingerprint.likeness(a, b) > least and fingerprint.likeness(a, c) > least


def test_interiors_share_names_at_any_offset():
    rng = random.Random(2)
    inner = "".join(rng.choice("abcdefgh ") for _ in range(600))
    own = brute_names(inner)
    for before in ("", "z", "zy", "some words before", "a" * 7):
        assert len(own & brute_names(before + inner + " behind")) > 0.8 * len(own)


def test_runs_of_other_lengths_share_names():
    for a, b in (("a" * 1000, "a" * 1001), ("ab" * 500, "ab" * 501), ("-" * 63, "-" * 64)):
        x, y = fingerprint.sketches([a, b])
        assert 0 < fingerprint.likeness(x, y) < 1
    text = "the quick brown fox jumps over a lazy dog, " * 3 + "then %s and rests under the old elm tree by the river"
    x, y = fingerprint.sketches([text % ("-" * 40), text % ("-" * 43)])
    assert fingerprint.likeness(x, y) > 0.5
