"""The filter audit: scanned counts against regular expressions, the query against a walk through every order."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import audit, byte_runs, queries

TEXTS = ["", " ", "a", "A a\x0ba\x1ca\x85a a  \ta\r\n", "é É ß日本 日本 日本\x00x \x00x", "x" * 300 + " " + "x" * 300 + " " + "x" * 299 + "y", "one two " * 150, "ab " * 199, "ab cd " * 100, "AB" + "c" * 98, "ABC" + "c" * 97, "it is #1", "100 %", "a|b"]


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text), hashlib.sha256(text.encode()).digest()


@pytest.mark.parametrize("window", [7, 1 << 20])
def test_measures(monkeypatch, window):
    default = byte_runs.windows.__defaults__
    monkeypatch.setattr(byte_runs.windows, "__defaults__", (window,))
    column = pa.array(["cut off", *TEXTS, "cut off"]).slice(1, len(TEXTS))
    found = audit.measure(column)
    assert [*zip(*([*found[name]] for name in ("words", "distinct", "capitals", "chars", "symbols", "digest")))] == [measures(t) for t in TEXTS]
    assert default == (byte_runs.WINDOW_BYTES,)


def test_equal_hashes_are_verified():
    data = np.frombuffer(b"ab ba ab abcdefghijk abcdefghijl", np.uint8)
    starts, ends = byte_runs.runs(data != 32, np.array([0]))
    assert audit.distinct_words(data, np.zeros(5, np.uint64), starts, ends, 1).tolist() == [4]


def test_stretches_of_any_length():
    rng = np.random.default_rng(2)
    data = np.tile(rng.integers(0, 3, 90).astype(np.uint8), 3)
    a, b, m, n = (rng.integers(0, 90, 3000), rng.integers(0, 90, 3000), rng.integers(0, 90, 3000), rng.integers(0, 90, 3000))
    n = np.where(rng.random(3000) < 0.7, m, n)
    a, b = np.where(rng.random(3000) < 0.5, b, a), b + 90
    expected = [data[i : i + x].tobytes() == data[j : j + y].tobytes() for i, j, x, y in zip(a, b, m, n)]
    assert byte_runs.Stretches(data).same(a, b, m, n).tolist() == expected and 100 < sum(expected) < 2900


def brute(docs, labels):
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good, toxic = ({i for i, *marks in labels if i is not None and marks[at] == 1} for at in (0, 1))
    parts = defaultdict(list)
    for i, text, source in docs:
        words, distinct, capitals, chars, symbols, _ = measures(text or "")
        fails = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 2 * chars, "D": symbols > 0, "E": i is not None and i > smallest[text or ""]}
        parts[source or ""].append(({x for x in fails if fails[x]}, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        removed = Counter()
        own = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                removed[x] += len(gone)
                failing = sum(x in r[0] for r in rows)
                own.append((part, order, step, len(left), len(gone), failing - len(gone), sum(r[0] == {x} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*r, removed[r[1][r[2] - 1]]) for r in own]
    return out


def test_query_on_hostile_rows(spark, tmp_path):
    docs = [(n, t, f"s{n % 3}") for n, t in enumerate(TEXTS * 3)] + [(None, "it is #1", "s1"), (None, "it is #1", "s1"), (None, None, None), (2, "a", "s2"), (2, "a", "s0"), (900, "a", ""), (901, None, None)]
    labels = [(n, n % 2, n % 5 == 0) for n in range(0, 40, 3)] + [(3, None, 1), (3, 0, None), (None, 1, 1), (9999, 1, 1), (901, 1, 1)]
    pq.write_table(pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs], "source": [d[2] for d in docs], "part": [1] * len(docs), "mask": [2] * len(docs), "good": ["x"] * len(docs)}), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": [x[1] for x in labels], "toxic": pa.array([None if x[2] is None else int(x[2]) for x in labels], pa.int32()), "n": [1] * len(labels)}), f"{tmp_path}/labels.parquet")
    found = queries.op12_filter_audit(spark, str(tmp_path))
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute(docs, labels))


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.masks(docs, labels)).collect() == []
    one = spark.createDataFrame([(1, "a", "s")], docs.schema)
    assert audit.audit(audit.masks(one, labels)).count() == 600
