"""Phrase collocations against counting by dictionaries."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import phrases


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", piece) if w] for piece in re.split(r"[.,;:!?\x0a-\x0d]", low)]


def brute(docs, most=2000, max_n=3, least=10, percent=50):
    count, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for size in range(1, max_n + 1):
                for at in range(len(words) - size + 1):
                    count[lang][tuple(words[at : at + size])] += 1
    out = []
    for lang, f in count.items():
        candidates = [p for p in f if len(p) > 1 and f[p] >= least]
        longer = defaultdict(int)
        for p in candidates:
            for size in range(2, len(p)):
                for at in range(len(p) - size + 1):
                    sub = p[at : at + size]
                    longer[sub] = max(longer[sub], f[p])
        rows = []
        for p in candidates:
            if 100 * longer[p] < percent * f[p]:
                score, k = min((10**6 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -score) for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:most], 1)]
    return out


def some_docs(seed=1, rows=120):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "The", "of", "hot", "pair", "été", "日本", "a-b", "x" * 300, "\x0cnew", "z\x00z", "A\x85b", "Éa", "end.", "it's,", "\t", "ß"] + [f"w{i}" for i in range(25)]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    docs = [(" ".join(rng.choice(vocabulary, 60, p=weights / weights.sum())), str(rng.choice(["en", "de"]))) for _ in range(rows)]
    docs += [("hot pair " * 400 + "tail", "en"), ("hot pair " * 400 + "tail", "en"), (None, "en"), ("", None), ("  \t ", None), ("one two three four " * 12, None), ("a,b;c:d!e?f\ng\rh", "en"), ("Is  onhe\tis onhe", "")]
    return docs


@pytest.mark.parametrize("group_bytes", [1 << 30, 500, 3])
def test_equals_counting(spark, monkeypatch, group_bytes):
    docs = some_docs()
    monkeypatch.setattr(phrases, "MOST_HOT", 40)
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in docs], "text string, lang string, n long, phrase string")
    found = phrases.collocations(df, group_bytes=group_bytes, most=50)
    assert sorted(map(tuple, found.collect())) == sorted(brute(docs, 50))


def test_longer_phrases(spark):
    docs = some_docs(2)
    df = spark.createDataFrame(docs, "text string, lang string")
    found = phrases.collocations(df, max_n=5, least=5, least_covered_percent=80, group_bytes=700)
    assert sorted(map(tuple, found.collect())) == sorted(brute(docs, 2000, 5, 5, 80))


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


@pytest.mark.parametrize("window", [5, 1 << 20])
def test_windows_and_lines(monkeypatch, window):
    monkeypatch.setattr(phrases, "WINDOW_BYTES", window)
    texts = [t or "" for t, _ in some_docs(3, 10)]
    part = pa.record_batch({"text": pa.array(["cut", *texts]).slice(1)})
    found = Counter()
    for words, rows in phrases._windows(part):
        first, last = np.arange(len(rows)), words.last_of_suffix(3)
        one, n = words.distinct(words.hashes(first, last), first, last)
        data, _ = words.lines(first[one], last[one])
        found.update(dict(zip(data.tobytes().decode().split("\n"), n.tolist())) if len(one) else {})
    expected = Counter(" ".join(words[at : at + 3]) for t in texts for words in pieces(t) for at in range(len(words)))
    assert found == expected


def test_equal_hashes_stay_apart():
    words = phrases.Words(np.frombuffer(b"ab ba ab cd", np.uint8), np.array([0]))
    at = np.arange(4)
    one, n = words.distinct(np.zeros(4, np.uint64), at, at)
    assert n.sum() == 4 and len(one) == 4


def test_stack_in_either_form_of_order():
    rng = np.random.default_rng(4)
    rows = Counter(tuple(rng.choice(list("abcdef"), rng.integers(1, 4))) for _ in range(500))
    lines, counts = pa.array(["".join(" ".join(r) + "\n" for r in rows)]), np.array([*rows.values()])
    for max_n in (3, 30):  # keys of one number, and of a column for each word
        found = {tuple(words[int(i)].as_py() for i in own[:depth]): int(c) for depth, words, ids, n in phrases.count_prefixes(lines, counts, max_n) for own, c in zip(ids, n)}
        expected = Counter()
        for r, n in rows.items():
            for depth in range(1, len(r) + 1):
                expected[r[:depth]] += n
        assert found == expected
