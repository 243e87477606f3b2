"""Near hashes and greedy choices among near rows, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import greedy, hamming
from tessera.sources.folders import cut


def flipped(draw, h, most, bits):
    for b in draw.sample(range(bits), draw.randint(0, most)):
        h ^= 1 << b
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("bits, most, parts, crowd", [(64, 8, 3, 4096), (64, 8, 3, 20), (64, 11, 3, 4096), (32, 3, 3, 4096), (24, 5, 4, 150), (64, 2, 2, 50), (64, 24, 8, 4096)])
def test_pairs_equal_all_comparisons(spark, bits, most, parts, crowd):
    """A third of the hashes shares its upper half, so that substrings have crowds."""
    draw, hashes = random.Random(bits * most), set()
    for k in range(110):
        h = draw.getrandbits(bits)
        if k % 3 == 0:
            h &= (1 << bits // 2) - 1
        hashes.update(flipped(draw, h, most + 2, bits) for _ in range(4))
    hashes |= {0, (1 << bits) - 1, (1 << bits) - 2}
    rows = [(signed(h) if bits == 64 else h,) for h in hashes]
    got = hamming.pairs(spark.createDataFrame(rows + rows[:9] + [(None,)], "hash long"), "hash", most, bits, cut, parts, crowd).collect()
    mask = (1 << 64) - 1
    want = [(a, b, n) for (a,) in rows for (b,) in rows if a < b and (n := ((a ^ b) & mask).bit_count()) <= most]
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 100


def test_a_crowd_is_dealt_again(spark):
    """All hashes share a third of their bits: rows that meet grow with the number of hashes, not with its square."""
    draw = random.Random(5)
    rows = [(draw.getrandbits(42),) for _ in range(3000)]
    rows += [(rows[k][0] ^ 5,) for k in range(100)]
    got = hamming.pairs(spark.createDataFrame(rows, "hash long"), "hash", 8, 64, cut, crowd=500)
    found = {tuple(r) for r in got.collect()}
    want = {(min(a, b), max(a, b), n) for i, (a,) in enumerate(rows) for (b,) in rows[:i] if a != b and (n := (a ^ b).bit_count()) <= 8}
    assert found == want


def kept_first(n, pairs):
    before, kept = {}, {}
    for a, b in pairs:
        before.setdefault(b, []).append(a)
    for i in range(n):
        kept[i] = not any(kept[a] for a in before.get(i, []))
    return kept


def random_pairs(n, m):
    draw = random.Random(n)
    return {(min(a, b), max(a, b)) for a, b in ((draw.randrange(n), draw.randrange(n)) for _ in range(m)) if a != b}


@pytest.mark.parametrize("n, pairs", [(10_000, {(i, i + 1) for i in range(9_999)}), (500, random_pairs(500, 900)), (300, {(0, i) for i in range(1, 300)}), (300, {(i, 299) for i in range(299)}), (5, set())])
def test_keep_first_of_near(spark, n, pairs):
    """A chain of 10,000, random pairs, a hub before and a hub after; rounds don't follow the chain's length."""
    rounds = []

    def counted(df):
        rounds.append(1)
        return cut(df)

    nodes = spark.range(n)
    near = spark.createDataFrame(sorted(pairs), "left_id long, right_id long")
    got = {r["id"]: r["kept"] for r in greedy.keep_first_of_near(nodes, near, counted).collect()}
    assert got == kept_first(n, sorted(pairs))
    assert len(rounds) <= 2 + 2 * 4  # two tables a round, at most a round a partition


def test_keep_first_across_partitions(spark):
    """The chain dealt over several ranges, without merging of small partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = sorted({(i, i + 1) for i in range(999)} | random_pairs(1000, 300))
        got = {r["id"]: r["kept"] for r in greedy.keep_first_of_near(spark.range(1000), spark.createDataFrame(pairs, "left_id long, right_id long"), cut).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == kept_first(1000, pairs)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_are_neither_broadcast_nor_joined(spark):
    """Copies of hashes are estimated far below their size: as rows of a join Spark would send them all to the driver."""
    draw = random.Random(9)
    df = spark.createDataFrame([(draw.getrandbits(62),) for _ in range(2000)], "hash long")
    assert "Join" not in plan(hamming.pairs(df, "hash", 8, 64, cut))


@pytest.mark.parametrize("bits, most, n", [(32, 3, 7_200_000), (64, 8, 5_400_000)])
def test_copies_and_comparisons_a_hash_stay_few(bits, most, n):
    """As many hashes as six times the driver's tables have: no more than 50 copies of a hash and 40,000 comparisons with others."""
    k = hamming._agreeing(n, most, bits, 3)
    choices = hamming._choices(tuple(range(bits)), most, (k,), 0)
    assert len(choices) <= 50 and sum(n / 2 ** held.bit_count() / 2 for held, _, _ in choices) <= 40_000


def test_pairs_that_meet_are_found_once(spark):
    """Bits that all hashes share, a crowd of them, and copies of a hash in several tasks."""
    draw = random.Random(11)
    hashes = sorted({(5 << 50) ^ sum(1 << b for b in draw.sample(range(40), draw.randint(0, 5))) for _ in range(700)})
    got = hamming.pairs(spark.createDataFrame([(h,) for h in hashes * 2], "hash long").repartition(5), "hash", 3, 64, cut, crowd=30).collect()
    want = [(a, b, n) for a in hashes for b in hashes if a < b and (n := (a ^ b).bit_count()) <= 3]
    assert sorted(tuple(r) for r in got) == want
