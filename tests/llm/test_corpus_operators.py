"""URL filters, WARC, quality, top-k, near-dedup, packing and the pipeline against brute force on small fixtures."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, minhash, packing, quality, queries, topk, url_filters, warc, words

WORDS = P.path("word_bpe_49k.json")


def test_url_keys(spark):
    df = spark.createDataFrame([("http://a.b.example.com/x/y?q#f",), ("HTTP://U@Host:80",), (None,), ("no url",), ("http://127/",), ("http://[2001:DB8::1]:80/x",), ("http://10.0.0.1/",), ("https://Example.com./a",)], "url string")
    assert [r[0] for r in df.select(url_filters.keys(F.col("url"))).collect()] == [["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/x", "a.b.example.com/x/y"], ["host"], [], [], ["127"], ["[2001:db8::1]", "[2001:db8::1]/x"], ["10.0.0.1"], ["example.com", "example.com/a"]]


def test_url_filter_follows_dates(spark):
    entries = spark.createDataFrame([("ex.com", "bad", "add", 10), ("ex.com", "bad", "remove", 20), ("ex.com", "bad", "add", 30), ("a.ex.com", "allow", "add", 15), ("ex.com", "bad", "remove", 40), ("ex.com", "bad", "add", 40), (None, "bad", "add", 1)], "key string, list string, action string, day long")
    captures = spark.createDataFrame([(d, "http://a.ex.com/p", d) for d in (9, 10, 14, 15, 19, 20, 30, 39, 40)] + [(100, "http://b.ex.com", 12), (101, None, 12), (102, "http://b.ex.com", None), (9, "http://a.ex.com/p", 9), (14, "http://a.ex.com/p", 14), (14, "http://a.ex.com/p", 14)], "id long, url string, day long").withColumn("key", F.lit("clash"))
    rows = url_filters.evaluate(captures, url_filters.intervals(entries)).collect()
    found = {r["id"]: (r["n_active"], r["blocked"]) for r in rows}
    assert len(rows) == len(found) and found == {9: (0, False), 10: (1, True), 14: (1, True), 15: (2, False), 19: (2, False), 20: (1, False), 30: (2, False), 39: (2, False), 40: (1, False), 100: (1, True), 101: (0, False), 102: (0, False)}
    assert url_filters.evaluate(captures.limit(0), url_filters.intervals(entries)).count() == 0
    assert url_filters.evaluate(captures, url_filters.intervals(entries.limit(0))).where("n_active > 0").count() == 0


def test_url_filter_takes_the_whole_path(spark):
    entries = spark.createDataFrame([("h.com/a/b/c/d/e/f", "bad", "add", 10), ("h.com/a/b/c/d/e/f/g", "allow", "add", 20)], "key string, list string, action string, day long")
    captures = spark.createDataFrame([(1, "http://h.com/a/b/c/d/e/f", 12), (2, "http://h.com/a/b/c/d/e", 12), (3, "http://h.com/a/b/c/d/e/f/g/h", 12), (4, "http://h.com/a/b/c/d/e/f/g/h", 20)], "id long, url string, day long")
    found = {r["id"]: (r["n_active"], r["blocked"]) for r in url_filters.evaluate(captures, url_filters.intervals(entries)).collect()}
    assert found == {1: (1, True), 2: (0, False), 3: (1, True), 4: (2, False)}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def test_warc_round_trip(spark):
    long, copied = "ä€\r\n\r\nWARC/1.1\r\n" * 3000, "copy " * 40
    rows = [(5, "http://x/\r\n", copied), (3, None, copied), (9, "u", copied), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", long), (7, "u", long), (None, "u", copied)]
    path = common.scratch(spark, "test") + "/a"
    warc.write_archive(pages(spark, rows), path, segment_bytes=1000)
    read = common.stored(warc.read_archive(spark, path), "read")
    payloads = Counter((r["page_id"], bytes(r["payload"])) for r in read.where("record_type = 'response'").collect())
    assert payloads == Counter({(3, copied.encode()): 1, (1, b"short"): 1, (2, b"short"): 1, (4, b""): 1, (6, b""): 1, (7, long.encode()): 2})
    found = Counter(tuple(r) for r in warc.resolved(read).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert found == Counter({(3, 200, "response", None): 1, (5, 200, "revisit", 3): 1, (9, 200, "revisit", 3): 1, (None, 200, "revisit", 3): 1, (1, 5, "response", None): 1, (2, 5, "response", None): 1, (4, 0, "response", None): 1, (6, 0, "response", None): 1, (7, len(long.encode()), "response", None): 2})


def test_warc_empty(spark):
    path = common.scratch(spark, "test") + "/a"
    warc.write_archive(pages(spark, [(1, "u", "x")]).limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_warc_finds_damage():
    payload = b"p" * 5000
    digest = hashlib.sha256(payload).hexdigest()
    records = warc.records_of(1, "u", payload, digest, None, 1000)
    parsed = [x for x in warc.parse_stream(iter([r + warc.SEPARATOR for r in records]))]
    segments = [{"origin_id": "o", "segment": int(f["warc-segment-number"]), "total": int(f.get("warc-segment-total-length", 0)) or None, "block": b, "copies": 1, "digest": digest, "record_id": "r", "record_type": "response", "page_id": 1, "refers_id": None} for f, b in parsed]
    assert [made[-1] for made in warc._assembled(segments, True)] == [payload]
    for broken in (segments[:-1], segments[:1] + segments[2:], [{**segments[0], "block": b"x" * 1000}, *segments[1:]]):
        with pytest.raises(ValueError):
            list(warc._assembled(broken, True))


@pytest.mark.parametrize("end", ["\r", "\r\n", "\r\n\r", "\r\n\r\n", "\n", "\n\n\r\n"])
def test_warc_blocks_may_end_in_line_breaks_at_file_ends(spark, end):
    head = len(warc.records_of(1, "u", b"", "d", None)[0].partition(warc.SEPARATOR)[2]) - len(warc.chunked(b""))
    before = warc.chunked(b"x" * 400).index(b"x")
    rows = [(n, "u", "y" * (n + 400 - head - before - len(end)) + end + "z" * 300) for n in range(-3, 4)]  # a segment of 400 bytes ends near `end`
    path = common.scratch(spark, "test") + "/a"
    warc.write_archive(pages(spark, rows).repartition(2), path, segment_bytes=400, file_records=1)
    read = warc.read_archive(spark, path)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in read.collect()} == {n: html for n, _, html in rows}


@given(st.binary(max_size=300), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_chunked_round_trip(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


def test_quality_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    model = quality.train(documents, ratings.where(~held), 3)
    assert np.all(np.diff(model.thresholds) > 0)
    rows = quality.score(documents.join(ratings.where(held).select("doc_id"), "doc_id"), model).join(ratings, "doc_id").collect()
    good = [r["tail_probability"] >= quality.LEAST_PROBABILITY for r in rows if r["grade"] == 2]
    bad = [r["tail_probability"] >= quality.LEAST_PROBABILITY for r in rows if r["grade"] < 2]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_quality_gradient_reaches_an_optimum():
    rng = np.random.default_rng(0)
    features = [np.array(sorted(set(rng.integers(0, 20, 5))), np.int32) for _ in range(600)]
    weight = rng.normal(0, 2, 20)
    grades = np.digitize([weight[f].sum() + rng.logistic() for f in features], [-1.0, 1.0])
    model = quality.fit(features, grades, 3, steps=1500, ridge=1e-6, screen=0.0)
    assert np.corrcoef(model.weights[:20], weight)[0, 1] > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "good words")], "doc_id long, text string").withColumn("expected_grade", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = quality.train(docs, none, 3)
    assert [r["tail_probability"] > 0.99 for r in quality.score(docs, model).collect()] == [True] * 4
    bad = quality.train(docs, spark.createDataFrame([(1, 0), (3, 0)], "doc_id long, grade int"), 3)
    assert quality.select_good(docs, bad).count() == 0
    assert quality.select_good(docs, model).columns == docs.columns and quality.select_good(docs, model).count() == 4


def brute_top(vectors, queries_, k):
    out = set()
    for qid, q in queries_:
        scores = sorted((-sum(a * b for a, b in zip(q, x)), xid) for xid, x in vectors if xid != qid)
        out |= {(qid, rank, xid, -score) for rank, (score, xid) in enumerate(scores[:k], 1)}
    return out


def test_top_k_with_ties(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.randint(-3, 3) for _ in range(20)]) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(200)] + [(900, [5]), (901, [])]
    df = spark.createDataFrame(vectors, "id long, v array<long>")
    found = topk.top_k(df.where("id % 50 = 0"), df.unionByName(df.where("id < 10")), 5, block_bytes=3 * 160, part_bytes=100 * 160)
    padded = [(i, v + [0] * (20 - len(v))) for i, v in vectors]
    assert {tuple(r) for r in found.collect()} == brute_top(padded, [(i, v) for i, v in padded if i % 50 == 0], 5)


def test_top_k_leaves_out_bad_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [0.5, None], 1), (2, [float("nan"), 1.0], 1), (3, None, 1), (4, [float("inf"), 0.0], 1), (5, [0.25, 0.5], 1), (None, [1.0, 1.0], 1)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int"))
    assert [tuple(r) for r in topk.top_k(v.where("id = 0"), v, 5).collect()] == [(0, 1, 5, 256 * 64 + 512 * 128)]
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_top_k_of_large_components(spark):
    large = spark.createDataFrame([(1, [1 << 40, 1]), (2, [1 << 31, 0]), (3, [-(1 << 40), 0]), (4, [3, 7]), (5, [(1 << 53) + 1, 1])], "id long, v array<long>")
    with pytest.raises(PySparkException, match="the score of 1 and 5 doesn't fit"):
        topk.top_k(large.where("id = 1"), large, 1).collect()
    few = large.where("id <> 5 AND id <> 2")
    assert [tuple(r) for r in topk.top_k(few.where("id = 1"), few, 1).collect()] == [(1, 1, 4, 3 * (1 << 40) + 7)]  # the other's isn't among the best
    with pytest.raises(PySparkException, match="the score of 1 and 3 doesn't fit"):
        topk.top_k(few.where("id = 1"), few, 2).collect()
    assert [tuple(r) for r in topk.top_k(large.where("id = 4"), large, 2).collect()] == [(4, 1, 5, 3 * ((1 << 53) + 1) + 7), (4, 2, 1, 3 * (1 << 40) + 7)]
    v = topk.integer_vectors(spark.createDataFrame([(1, [1e300, 1.0]), (2, [1.0, 1.0]), (3, [-0.001, 0.5]), (4, [0.0, 2.0])], "vec_id long, embedding array<double>"))
    found = topk.top_k(v.where("id = 4"), v.where("id <> 1"), 5)  # one vector of huge components stops no other query
    assert [tuple(r) for r in found.collect()] == [(4, 1, 2, 512 * 256), (4, 2, 3, 512 * 128)]
    assert [tuple(r) for r in topk.top_k(v.where("id = 4"), v, 5).collect()] == [(4, 1, 1, 512 * 256), (4, 2, 2, 512 * 256), (4, 3, 3, 512 * 128)]


def near_copies(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(30, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = [w if rng.random() > rng.choice([0.0, 0.01, 0.03, 0.08]) else rng.choice(words) for w in base]
            texts.append(" ".join(copy))
    texts += ["", None, "!!", "!!", "one two", "One, two!", "x " * 40]
    rng.shuffle(texts)
    return texts


def brute_classes(texts, idf):
    made = []
    for t in texts:
        t = t or ""
        found, counts = minhash.shingles(minhash.word_hashes(t))
        made.append((found, idf.weights(found, counts)) if len(found) else t)
    root = list(range(len(texts)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            same = made[i] == made[j] if isinstance(made[i], str) or isinstance(made[j], str) else minhash.similar(made[i], made[j])
            if isinstance(made[i], str) != isinstance(made[j], str):
                same = False
            if same:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_dedup_is_brute_force(spark):
    texts = near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).withColumn("key", F.lit("clash"))
    found = {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()}
    idf = minhash.Idf(*minhash.common_shingles(df))
    assert [found[i] for i in range(len(texts))] == brute_classes(texts, idf)
    kept = sorted(r["doc_id"] for r in minhash.deduplicate(df).collect())
    assert kept == sorted(set(found.values()))


def test_near_dedup_edges(spark):
    schema = "doc_id long, text string"
    assert minhash.classes(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(4, "a b c d e f g"), (4, "a b c d e f g"), (None, "a b c d e f g"), (None, "z z"), (2, "A b, c d e f g")], schema)
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in minhash.classes(df).collect()) == [("2", "2"), ("4", "2"), ("4", "2"), ("None", "2"), ("None", "None")]


def test_near_dedup_keeps_a_row_of_each_class(spark):
    words = [f"w{i}" for i in range(200)]
    x, near = " ".join(words), " ".join(words[:-1])
    y, z = " ".join(f"y{i}" for i in range(50)), [f"z{i}" for i in range(200)]
    rows = [(3, x, 1), (5, near, 2), (5, y, 3), (None, near, 4), (None, x + "!", 5), (7, "q r s", 6), (7, "Q, r s", 7), (None, " ".join(z), 8), (None, " ".join(z[:-1]), 9), (None, "alone", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    assert df.columns == minhash.deduplicate(df).columns
    kept = [(r["doc_id"], r["n"]) for r in minhash.deduplicate(df).collect()]
    assert len(kept) == 5 and {n for _, n in kept} & {1, 3, 10} == {1, 3, 10}
    assert len({n for _, n in kept} & {6, 7}) == 1 and len({n for _, n in kept} & {8, 9}) == 1


def test_near_dedup_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(2, text, "a", "b", 1), (1, text, "c", "d", 2), (1, text, "e", None, 3), (3, "other words", None, None, 4)], "doc_id long, text string, `ROW` string, key string, class_id long")
    for name in ("root", "bands", "row1", "found", "again", "n"):
        df = df.withColumn(name, F.lit(7))
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns
    rows = kept.orderBy("doc_id").collect()
    assert [(r["doc_id"], r["found"]) for r in rows] == [(1, 7), (3, 7)] and rows[0]["class_id"] in (2, 3)
    assert {r["class_id"] for r in minhash.classes(df).collect()} == {1, 3}


def test_near_dedup_of_one_repeated_row(spark):
    """One row of each class stays, also of rows that are equal, have no id, or share an id with another text."""
    x, y = "one two three four five six", "a wholly different text of some length"
    df = spark.createDataFrame([(4, "p q r s t u"), (4, "p q r s t u"), (None, "v w x y z"), (None, "v w x y z"), (1, x), (5, x), (5, y)], "doc_id long, text string")
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in minhash.deduplicate(df).collect()))) == sorted(map(str, [(4, "p q r s t u"), (None, "v w x y z"), (1, x), (5, y)]))


@pytest.mark.parametrize("few", [0, 15, 1000])
def test_components_by_steps_and_in_one_task(spark, few):
    rng = random.Random(few)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(12)] + [(200, 201 + i) for i in range(20)] + [(5, 5)]
    root = list(range(300))
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    name = lambda i: f"{i:04}".encode()
    found, _ = minhash.components(spark.createDataFrame([(name(a), name(b)) for a, b in links], "a binary, b binary"), few)
    linked = {i for a, b in links if a != b for i in (a, b)}
    assert sorted((bytes(r["node"]), bytes(r["root"])) for r in found.collect() if r["node"] != r["root"]) == sorted((name(i), name(root[i])) for i in linked if root[i] != i)
    assert minhash.components(spark.createDataFrame([], "a binary, b binary"), few)[0].count() == 0


def test_samples_agree_like_weighted_jaccard():
    rng = np.random.default_rng(5)
    agree, expected = [], []
    for _ in range(60):
        items = np.unique(words.mixed(rng.integers(1, 2**62, 300).astype(np.uint64)))
        a, b = rng.integers(1, 4, len(items)) * 1.5, rng.integers(1, 4, len(items)) * 1.5
        agree.append((minhash.samples(items, a) == minhash.samples(items, b)).mean())
        expected.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree) - np.mean(expected)) < 0.02


def test_common_shingles_are_exact(spark):
    texts = ["a b c d e f"] * 30 + [f"q{i} r s t u" for i in range(60)] + ["v w x y z"] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    hashes, shares = minhash.common_shingles(df)
    assert sorted(np.round(shares, 6)) == [round(30 / 99, 6)] * 2


@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_plan_places_every_piece(lengths):
    counts = Counter(lengths)
    patterns = packing.plan(counts, 40)
    used = Counter()
    for times, chosen in patterns:
        assert times > 0 and sum(length * n for length, n in chosen.items()) <= 40
        for length, n in chosen.items():
            used[length] += n * times
    assert used == counts
    best_fit = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in best_fit if g >= length]
        if fitting:
            best_fit.remove(min(fitting))
        best_fit.append((min(fitting) if fitting else 40) - length)
    assert sum(t for t, _ in patterns) <= len(best_fit) + 2


@pytest.mark.parametrize("special_as_text", [False, True])
def test_tokens_are_the_librarys(special_as_text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = special_as_text
    texts = ["", "  \n ", "Don't STOP-now, we'LL… İstanbul'S", "a\tb\r\nc\x1cd", "ﬁ éa É ½ ²a ΣΑΣ", "<|endoftext|> x a<|startoftext|>b <|ENDOFTEXT|>", "word, word. Word! (word) --"]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.Tokens(WORDS, special_as_text).of(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tokens_refuse_a_tokenizer_that_crosses_blanks(tmp_path):
    with pytest.raises(ValueError):
        packing.Tokens(P.path("byte_bpe_50k.json"))


def test_packing_ranks_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_PIECES", 7)
    df = spark.createDataFrame([(None, "same words")] * 40 + [(1, "same words"), (2, "b")], "doc_id long, text string")
    rows = packing.pack(packing.tokenize(df, WORDS, capacity=9, with_ids=False), 9).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == 42
    assert len({r["sequence_id"] for r in rows}) == 14


def test_packing_is_gapless(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) for _ in range(300)] + ["a"] * 200 + [None, "b " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("length", F.lit("clash"))
    rows = packing.pack(packing.tokenize(df, WORDS, capacity=128, with_ids=False), 128).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r["length"] for r in rows)
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) and len(by_sequence) <= -(-total // 128) + 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 501) == 701
    assert packing.pack(packing.tokenize(df.limit(0), WORDS, with_ids=False)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    all_ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept <= all_ids and len(kept) > len(all_ids) / 2
        all_ids = kept
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()} == all_ids


def test_every_query_is_registered():
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
