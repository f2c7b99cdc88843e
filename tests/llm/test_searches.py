"""Hard negatives, benchmark decontamination and fill-in-middle against brute force, and on odd rows."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import decontamination, fill_in_middle, hard_negatives, queries

SF = "/root/testdata/sf0.001"
CLASH = ["n", "form", "output", "items", "hits", "n_words", "_raw", "_fim_text", "id", "vector", "score", "rank", "_r", "_a", "a.b", "contaminated"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# 11 hard negatives


def brute_negatives(rows, positives=5, negatives=3):
    """rows: {id: (label, integers)}."""
    out = []
    width = max((len(v) for _, v in rows.values()), default=0)
    rows = {i: (label, [*v, *[0] * (width - len(v))]) for i, (label, v) in rows.items()}
    for a, (label, v) in rows.items():
        if a % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, (_, w) in rows.items() if i != a)
        own = [(-s, i) for s, i in scores if rows[i][0] == label][:positives]
        for ps, p in own:
            found = [(-s, i) for s, i in scores if rows[i][0] != label and 50 * ps <= -100 * s <= 95 * ps][:negatives]
            out += [(a, p, k + 1, i, ps, s) for k, (s, i) in enumerate(found)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id") % 50 == 0).collect())


@pytest.mark.parametrize("shape", ["blobs", "ties", "copies"])
def test_negatives_against_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(hard_negatives, "ROWS", 90)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "STRIP", 300)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 24)) * 30
    rows = {}
    for i in range(600):
        label = int(rng.integers(4))
        if shape == "ties":
            v = rng.integers(-1, 2, 24)
        elif shape == "copies" and i % 3:
            v = np.full(24, 7)  # two thirds are one vector
        else:
            v = np.rint(centres[label] * 0.5 + centres[0] + rng.normal(size=24) * 12)
        rows[i - 100] = (label, [int(x) for x in v])
    df = spark.createDataFrame([(i, label, v) for i, (label, v) in rows.items()], "id long, label long, vector array<long>")
    got, want = mined(df), brute_negatives(rows)
    assert got == want and (want or shape == "copies")


def test_negatives_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(50, [0.5, 0.25], 1), (50, [0.5, 0.25], 1), (1, [0.5, 0.24], 1), (2, [0.4, 0.2], 2), (3, [0.4], 2), (4, [], 1), (None, [1.0, 1.0], 1), (5, None, 1), (6, [nan, 1.0], 2), (7, [1.0, -inf], 2), (8, [None, 1.0], 2), (9, [1.0, 1.0], None), (100, [-0.001, 0.0], 3), (0, [], 2)]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    rows = hard_negatives.quantised(df)
    clean = {i: (label, [int(np.floor(np.float32(x).astype(float) * 256)) for x in v]) for i, v, label in odd if i in (50, 1, 2, 3, 4, 100, 0)}
    assert {r["id"]: (r["label"], r["vector"]) for r in rows.collect()} == clean
    assert mined(rows) == brute_negatives(clean)
    assert mined(rows.limit(0)) == [] and mined(rows.filter("id = 50")) == []


def test_negatives_of_large_components(spark):
    rows = {0: (1, [2**33, 1]), 1: (1, [2**29, 5]), 2: (2, [2**28, 3]), 3: (2, [2**27, 2**27])}
    df = spark.createDataFrame([(i, label, v) for i, (label, v) in rows.items()], "id long, label long, vector array<long>")
    assert mined(df) == brute_negatives(rows) != []


def test_rotation_discards_most_pairs():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 48)) * 60
    import pyarrow as pa

    x = np.rint(base + rng.normal(size=base.shape)).astype(int)
    turn = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1]
    block = hard_negatives.Block(pa.table({"id": range(400), "label": [0] * 400, "vector": pa.array(list(x), pa.list_(pa.int64()))}), 48, turn)
    allowed, every = ~np.eye(400, dtype=bool), np.full((400, 1), np.inf)
    i, j, score = hard_negatives._pairs(block, block, slice(0, 400), allowed, -every, every, 0 / every, 5, 48)
    assert len(i) < 0.1 * 400 * 400 and (score == (x[i] * x[j]).sum(1)).all()
    whole = np.where(allowed, x @ x.T, -(2**60))
    kth = np.sort(whole, 1)[:, -5]
    assert {(a, b) for a, b in zip(*np.nonzero(whole >= kth[:, None]), strict=True)} <= set(zip(i.tolist(), j.tolist(), strict=True))


# 12 decontamination

ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_hits(text, items, size=10):
    words = [m for m in ITEM_WORD.finditer(lowered(text))]
    plain, hit, owners = [m[0] for m in words], set(), set()
    for item, body in items:
        own = ITEM_WORD.findall(lowered(body))
        for i in range(max(len(own) - size, 0) + 1 if own else 0):
            window = own[i : i + size]
            for at in range(len(plain) - len(window) + 1):
                if plain[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    owners.add("" if item is None else str(item))
    return len(plain), hit, sorted(owners), words


def check_hits(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(df, bench)
    assert set(got.columns) == {"doc_id", "text", *CLASH, "n_hit", "passages"}
    found = got.collect()
    assert len(found) == len(docs)
    want = {}
    for d, t in docs:
        n, hit, owners, words = brute_hits(t, items)
        pieces = []
        for k in sorted(hit):
            if k - 1 in hit:
                pieces[-1][1] = words[k].end()
            else:
                pieces.append([words[k].start(), words[k].end()])
        want[d, t] = (n, len(hit), owners, [tuple(p) for p in pieces], bool(hit))
    for r in found:
        assert (r["n_words"], r["n_hit"], r["items"], [tuple(p) for p in r["passages"]], r["contaminated"]) == want[r["doc_id"], r["text"]]


def random_texts():
    r = random.Random(3)
    words = ["Aa", "b", "c'", "é", "漢字", "7", "x-y", "\x00z", "ÄB"]
    items = [(i, " ".join(r.choice(words[:4]) for _ in range(r.choice([1, 2, 9, 10, 11, 25])))) for i in range(8)]
    docs = [(i, r.choice(["", "¿ ", "-"]).join([r.choice([" ", "\n", ". "]).join(r.choice(words) for _ in range(r.randrange(40))), r.choice(items)[1].upper() if i % 2 else "", " ", r.choice(items)[1]])) for i in range(60)]
    return docs, items


def test_hits_against_brute_force(spark, monkeypatch):
    docs, items = random_texts()
    odd = [(-1, None), (-2, ""), (-3, " .,\t"), (None, items[0][1]), (-4, items[1][1]), (-4, items[1][1])]
    items += [(99, None), (98, "..."), (None, "b b b b b"), (3, items[5][1])]
    check_hits(spark, docs + odd, items)
    monkeypatch.setattr(decontamination, "BLOCK", 100)  # blocks of a few items
    monkeypatch.setattr(decontamination, "AT_ONCE", 7)  # and a document's words in many runs
    check_hits(spark, docs + odd, items)


def test_hits_of_empty_tables(spark):
    docs, items = random_texts()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.decontaminate(df.limit(0), bench).collect() == []
    clean = decontamination.decontaminate(df, bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] or r["items"] for r in clean)


def test_scanning_a_long_repetitive_text_is_linear():
    windows = decontamination.Windows([(str(i), b"a " * (10 + i)) for i in range(50)] + [("b", b"a a a")], 10)
    began = time.process_time()
    n, runs, items = windows.scan(b"a " * 300_000 + b"c " + b"a a a")
    assert (n, runs, len(items)) == (300_004, [[0, 299_999], [300_001, 300_003]], 51)
    assert time.process_time() - began < 10


# 13 fill-in-middle


def brute_middle(key, text):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middles_against_brute_force(spark):
    r = random.Random(8)
    pieces = ["a", "Zz", " ", "é", "漢字", "😀", "\n", "<", "<P", ">", "9", "word" * 30, "S>", "<M", "\x00", " "]
    docs = [(i, "".join(r.choice(pieces) for _ in range(r.randrange(60)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "<P>"), (1003, "a<S>b"), (1004, "x<M>"), (1005, "é" * 5000), (1006, "one Two " * 40_000), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    made = fill_in_middle.fill_in_middle(df)
    found = made.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(docs) and {x["form"] for x in found} == {"plain", "psm", "spm"}
    for x in found:
        assert (x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) == brute_middle(x["doc_id"], x["text"] or "")
        assert x["back"] == (x["text"] or "")
    assert fill_in_middle.fill_in_middle(df.limit(0)).collect() == []
    null = fill_in_middle.fill_in_middle(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).first()
    assert (null["n"], null["form"], null["prefix_chars"], null["middle_chars"], null["output"]) == brute_middle("", "a b c")


def test_select_finds_every_rank():
    r = random.Random(2)
    for width in (1, 2, 3, 64, 65, 1000):
        bits = r.getrandbits(width) | 1 << (width - 1)
        assert [fill_in_middle.select(bits, k) for k in range(bits.bit_count())] == [i for i in range(width) if bits >> i & 1]


def test_bytes_that_are_no_text_stay(spark):
    df = spark.sql("SELECT 4L AS doc_id, CAST(X'61ff2062' AS STRING) AS text")
    made = fill_in_middle.fill_in_middle(df)
    got = bytes(made.select(F.col("output").cast("binary").alias("b")).first()["b"])
    assert sorted(re.sub(b"<[PSM]>", b"", got)) == sorted(b"a\xff b")


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_decontamination", "op13_fill_in_middle"])
def test_queries_have_their_columns(spark, name):
    columns = {
        "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
        "op12_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
        "op13_fill_in_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    }[name]
    df = queries.queries()[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns and df.count() > 0
