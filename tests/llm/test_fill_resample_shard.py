"""Operators 11 to 13 against brute-force versions, on the small table, on odd rows and on hot groups."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_middle, resampling, sharding

RUNS = {"fill": fill_middle.fill_in_middle_digests, "resample": lambda d: resampling.resample(d, d), "shard": sharding.sharded}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables_and_odd_rows(name, empty, edge):
    assert rows_of(RUNS[name](empty)) == []
    odd = edge.select(*edge.columns, *(F.lit(7).alias(c) for c in ("size", "digest", "shard", "at", "n_words", "short", "output", "form", "r")))
    got = rows_of(RUNS[name](odd))
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in edge.collect())
    assert sorted(map(repr, got)) == sorted(map(repr, rows_of(RUNS[name](odd.repartition(7)))))


def filled(doc_id, text, percent=100):
    """n, form, prefix, middle, output by the contract's words, with the standard library."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), (f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


SENTINELS = [(20, "a <M> b\nc"), (21, "<P>"), (22, "<\nP>x\n<S"), (23, "\n\n\n"), (24, "x\r\ny z\n日本\n𝒳 end"), (25, "<S\n>" * 9), (26, "M>\n<P\n<M"), (-5, "one\ntwo\n")]


@pytest.mark.parametrize("percent", [100, 40])
def test_fill_in_middle(spark, small, edge, percent):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(edge.select("doc_id", "text")).union(spark.createDataFrame(SENTINELS, "doc_id long, text string"))
    recipe = fill_middle.Recipe(percent=percent)
    want = Counter((r[0], *filled(r[0], r[1] or "", percent)) for r in docs.collect())
    whole = fill_middle.fill_in_middle(docs, recipe)
    assert Counter(tuple(r) for r in whole.collect()) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert Counter(tuple(r) for r in fill_middle.restore(whole, recipe).collect()) == Counter((r[0], r[1] or "") for r in docs.collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = Counter((*filled(r[0], r[1] or "", percent)[:4], sha(filled(r[0], r[1] or "", percent)[4]), sha(r[1] or "")) for r in docs.collect())
    assert Counter(tuple(r)[1:] for r in fill_middle.fill_in_middle_digests(docs, recipe).collect()) == texts


def test_other_units_and_sentinels(spark):
    recipe = fill_middle.Recipe(unit=r"\S+\s*|\s+", prefix="[[p", suffix="{s", middle="|m|x")
    rows = [(i, f" word{i} and  more\tof [it\n" * (i % 5)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in fill_middle.restore(fill_middle.fill_in_middle(docs, recipe), recipe).collect()) == rows
    for marks in (("aa", "<S>", "<M>"), ("<P>", "", "<M>"), ("<P>", "<P>", "<M>"), ("x<", "<x", "y"), ("<PSM>", "PSM", "z")):
        with pytest.raises(ValueError):
            fill_middle.Recipe(prefix=marks[0], suffix=marks[1], middle=marks[2])


def resampled(docs, target, run, buckets, least, percent):
    """(doc_id, n_features, weight, score, rank) by plain loops."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    runs = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]
    s, t = (Counter(b for x in texts for b in runs(cut(x))) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, x in docs:
        f, h = runs(cut(x)), int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f)) // len(f) if f else 0
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(cut(x)) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = percent * len(order) // 100
    return Counter([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(order)] + [(*r[:4], None) for r in rows if not r[4]])


@pytest.mark.parametrize("run, buckets, most, percent", [(1, 10_000, 1_000_000, 10), (2, 500, 300, 35), (3, 50, 1_000_000, 100)])
def test_resampling(spark, small, edge, run, buckets, most, percent):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(edge.select("doc_id", "text"))
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    got = Counter(tuple(r) for r in resampling.resample(docs, target, run, buckets, 20, percent, most=most).collect())
    want = resampled([tuple(r) for r in docs.collect()], [r["text"] for r in target.collect()], run, buckets, 20, percent)
    assert got == want and sum(r[4] is not None for r in got.elements()) > 10


def test_tries_start_anew_in_either_pass(spark):
    """Words beyond ``most`` of every size: tries of many words that are walked without being counted, and slices that bring more
    words than the trie before them had."""
    sizes = (3, 9, 6_000, 40, 7_000, 7_500, 2)
    docs = [(k, " ".join(f"w{k}x{i}" for i in range(n)) + " common") for k, n in enumerate(sizes)]
    target = ["w2x1 w4x5 w4x5 common", "w5x7 other"]
    for most in (2, 5_000):
        walked = resampling.WordTrie(1, 500, most)
        for k, (_, text) in enumerate(docs):
            assert walked.walk(pa.array([text]))[0].tolist() == [sizes[k] + 1]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = Counter(tuple(r) for r in resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), 1, 500, 2, 50, most=2).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == resampled(docs, target, 1, 500, 2, 50)


def test_resampling_ranks_ties_by_id(spark):
    """Equal ids give equal scores; a third of all rows has one id."""
    docs = spark.createDataFrame([(5 if i % 3 else i, "one two three") for i in range(90)], "doc_id long, text string")
    got = rows_of(resampling.resample(docs, docs, least_words=3, percent=50))
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 46)) and [r["score"] for r in drawn] == sorted((r["score"] for r in got), reverse=True)[:45]


def smallest_capacity(sizes, shards):
    fits = lambda c: sum(1 for _ in greedy(sizes, c)) <= shards
    c = max([*sizes, -(-sum(sizes) // shards)])
    while not fits(c):
        c += 1
    return c


def greedy(sizes, capacity):
    at = 0
    for s in sizes:
        if at + s > capacity:
            yield at
            at = 0
        at += s
    yield at


def checked(docs, got, shards):
    """The law's conditions; returns bytes by shard."""
    texts = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())): t or "" for i, t in docs}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    slots, where, total = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        where[texts[r["doc_id"], r["size"], r["text_crc32"]]].add(r["shard"])
        total[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(w) == 1 for w in where.values())
    return total


@pytest.mark.parametrize("digits", [3, 1])
@pytest.mark.parametrize("shards", [24, 5])
def test_shards_are_minimax(spark, small, digits, shards):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sharding.written(sharding.sized(docs), "t")
    plan = sharding.minimax(sharding.grouped(rows), shards, digits)
    groups = Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        groups[hashlib.sha256(raw).hexdigest()[:32]] += len(raw) + 8
    order = [n for d, n in sorted(groups.items()) if d not in plan.alone]
    assert plan.capacity == smallest_capacity(order, shards - len(plan.alone))
    total = checked([(r["doc_id"], r["text"]) for r in docs.collect()], rows_of(sharding.sharded(docs, shards)), shards)
    assert max(total.values()) == max([plan.capacity, *(groups[d] for d in plan.alone)])


def test_shards_of_hot_groups(spark):
    """Groups longer than a shard's share get shards of their own, and the others share what is left evenly."""
    docs = [(i, "hot text " * 20) for i in range(400)] + [(1000 + i, "warm " * 5) for i in range(20)] + [(5000 + i, f"text {i} " * (1 + i * i % 40)) for i in range(500)] + [(None, None), (1, ""), (1, "")]
    got = rows_of(sharding.sharded(spark.createDataFrame(docs, "doc_id long, text string"), 8))
    total = checked(docs, got, 8)
    hot = {r["shard"] for r in got if r["size"] == len("hot text " * 20) + 8}
    others = [n for s, n in total.items() if s not in hot]
    assert len(total) == 8 and max(others) < 1.1 * min(others)


def test_fewer_groups_than_shards(spark):
    docs = [(i, "abc"[i % 3]) for i in range(9)]
    got = rows_of(sharding.sharded(spark.createDataFrame(docs, "doc_id long, text string")))
    assert len(checked(docs, got, 24)) == 3


def test_shards_are_written_with_all_columns(spark, edge, tmp_path):
    docs = edge.withColumn("shard", F.lit("own"))
    sharding.write_shards(docs, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(repr, rows_of(back.select(*docs.columns)))) == sorted(map(repr, rows_of(docs)))
    assert {(r["doc_id"], r["shard_"]) for r in back.collect()} == {(r["doc_id"], r["shard"]) for r in sharding.sharded(docs, 4).collect()}
