"""Sharding, mixing, near copies, decontamination, fingerprints, licenses and quality against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import decontamination, fingerprints, licenses, mixing, near_duplicates, quality, ranges, sharding

WORD = re.compile(r"[A-Za-z0-9_\u0080-\U0010ffff]+")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- sharding


def check_shards(found, n, shards):
    assert len(found) == n
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_shards_of_odd_rows(odd_docs, no_docs):
    check_shards(sharding.shard_documents(odd_docs, 3).collect(), odd_docs.count(), 3)
    assert sharding.shard_documents(no_docs).count() == 0


def test_shards_are_even_and_keep_groups(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 150, "copy" * 30).otherwise(F.repeat(F.col("id").cast("string"), (F.col("id") % 90).cast("int"))).alias("text"))
    found = sharding.shard_documents(rows, 8).collect()
    check_shards(found, 3000, 8)
    size = defaultdict(int)
    for r in found:
        size[r.shard] += r.size
    mean = sum(size.values()) / 8
    assert max(abs(s - mean) for s in size.values()) < 0.01 * mean
    assert len({r.shard for r in found if r.doc_id < 150}) == 1
    # a group above a whole shard is spread
    most = rows.withColumn("text", F.when(F.col("doc_id") < 2000, "copy" * 30).otherwise(F.col("text")))
    size = defaultdict(int)
    for r in sharding.shard_documents(most, 8).collect():
        size[r.shard] += r.size
    assert max(size.values()) < 1.1 * min(size.values())


def test_shards_of_one_row_many_times(spark):
    """Rows equal in id and text, a third of the table, are numbered in many tasks."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text of all").otherwise(F.concat(F.lit("t"), "id")).alias("text")
    )
    found = sharding.shard_documents(rows, 4).collect()
    check_shards(found, 9000, 4)
    size = defaultdict(int)
    for r in found:
        size[r.shard] += r.size
    assert max(size.values()) < 1.05 * min(size.values())


def test_splitters_meet_their_targets(spark):
    rng = np.random.default_rng(5)
    data = [(int(p), int(s)) for p, s in zip(rng.integers(0, 1 << 62, 2000), rng.integers(1, 50, 2000))]
    total = sum(s for _, s in data)
    targets = [total * k / 5 for k in range(1, 5)]
    found = sharding.find_splitters(spark.createDataFrame(data, "pos long, size long"), targets, 60, probes=8)
    assert all(abs(sum(s for p, s in data if p < f) - t) <= 60 for f, t in zip(found, targets))


# ---- mixing


def test_mix_of_odd_rows(odd_docs, no_docs):
    found = mixing.mix_sources(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert rows_of(mixing.mix_sources(odd_docs)) == sorted(map(tuple, found), key=repr)
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in found)
    assert mixing.mix_sources(no_docs).count() == 0
    for few in (0, 1000):
        applied = mixing.apply_mix(odd_docs, mixing.plan_mix(odd_docs, broadcast_rows=few)[0])
        assert applied.dtypes == odd_docs.dtypes
        want = Counter()
        for r in found:
            want[r.doc_id, r.text_hash] += r.copies
        got = Counter((r.doc_id, r.h) for r in applied.select("doc_id", F.xxhash64("text").alias("h")).collect())
        assert got == +want
    assert mixing.apply_mix(no_docs, mixing.plan_mix(no_docs)[0]).count() == 0


def test_targets_and_taken(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 13 + 1).cast("int")).alias("text"),
    )
    found = mixing.mix_sources(rows).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(sizes)
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    left, open_, want = 1.5 * sum(sizes.values()), set(names), {}
    while over := [n for n in open_ if weight[n] * left / sum(weight[m] for m in open_) > 2 * sizes[n]]:
        for n in over:
            want[n] = 2 * sizes[n]
        left -= sum(want[n] for n in over)
        open_ -= set(over)
    want |= {n: weight[n] * left / sum(weight[m] for m in open_) for n in open_}
    assert all(abs(target[n] - want[n]) < 1e-6 for n in names)
    assert all(abs(taken[n] - target[n]) <= 13 for n in names)


@pytest.mark.parametrize("few", [0, 1000])
def test_mix_against_brute_force(spark, few):
    """Every row's copies, with weights far apart, repeated rows, null ids and sources, and ranges refined to single rows."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(200)]), " ".join("w" * rng.randint(0, 9)), rng.choice([None, "a", "b", "hot", "hot", "hot"])) for _ in range(500)]
    rows += [(7, "w w w", "hot")] * 120 + [(None, "w w", "b")] * 40
    weights = [(k, 10.0 ** rng.randint(-3, 3)) for k in range(150)] + [(None, 1e6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quality_ = spark.createDataFrame(weights, "doc_id long, weight double")
    found = mixing.mix_sources(docs, quality_, rows_a_range=5, broadcast_rows=few)
    got = Counter((r.doc_id, r.source, r.size, r.copies) for r in found.collect())
    target = {r.source: (r.source_size, r.target) for r in found.collect()}
    seen, by_source, known = Counter(), defaultdict(list), dict(weights)
    for i, text, source in rows:
        key = ":".join(("17", "null" if i is None else str(i), hashlib.md5(text.encode()).hexdigest(), str(seen[i, text, source])))
        seen[i, text, source] += 1
        u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) * 2.0**-52
        by_source[source].append((math.log(-math.log(u)) - math.log(1.0 if i is None else known.get(i, 1.0)), i is not None, i or 0, len(text.split()), i))
    want = Counter()
    for source, drawn in by_source.items():
        size, goal = target[source]
        epochs = int(goal // size)
        rest, before = goal - epochs * size, 0
        for _, _, _, n, i in sorted(drawn):
            want[i, source, n, epochs + (before + n / 2 <= rest)] += 1
            before += n
    assert got == want
    applied = mixing.apply_mix(docs, mixing.plan_mix(docs, quality_, rows_a_range=5, broadcast_rows=few)[0])
    assert applied.count() == sum(c * n for (*_, c), n in want.items())


def test_better_documents_are_taken_more_often(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    weights = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(0.25).alias("weight"))
    found = mixing.mix_sources(rows, weights).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("copies").alias("n")).collect()
    n = {r.odd: r.n for r in found}
    assert sum(n.values()) == 3000 and n[0] > 1.6 * n[1]


# ---- near copies


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        own = (k is not None, k or 0)
        least[find(i)] = min(least.get(find(i), own), own)
    return sorted(((k, least[find(i)][1] if least[find(i)][0] else None, links[i]) for i, (k, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_near_copies(spark, odd_docs, broadcast_rows):
    found = near_duplicates.near_duplicates(odd_docs, broadcast_rows=broadcast_rows).select("doc_id", "class_id", "n_links")
    assert rows_of(found) == brute_near([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_near_copies_in_several_blocks(spark, no_docs):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            words[at] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"y{k}" for k in rng.integers(0, 90, 60))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates.near_duplicates(docs, block=16, texts_a_side=5)
    assert rows_of(found.select("doc_id", "class_id", "n_links")) == brute_near(rows)
    kept = near_duplicates.keep_first_of_class(docs, found)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute_near(rows)})
    assert near_duplicates.near_duplicates(no_docs).count() == 0


def test_chains_of_unlike_texts_make_few_blocks(spark):
    """Classes that bands connect one by one meet their neighbours alone, not the whole chain."""
    n = 600
    rows = [(k, 1, [1000 + k, 1001 + k, -k - 1]) for k in range(n)]
    reps = spark.createDataFrame(rows, "uid long, copies long, bands array<long>")
    met = near_duplicates.candidate_blocks(reps, 16).collect()
    held = defaultdict(set)
    for r in met:
        held[r.a, r.b].add(r.uid)
    assert all(any({k, k + 1} <= h for h in held.values()) for k in range(n - 1))
    assert len(met) < 12 * n and max(map(len, held.values())) <= 12
    # one band of all: chunks of bounded size, and every two of them
    reps = spark.createDataFrame([(k, 1, [5]) for k in range(n)], "uid long, copies long, bands array<long>")
    held = defaultdict(set)
    for r in near_duplicates.candidate_blocks(reps, 100).collect():
        held[r.a, r.b].add(r.uid)
    assert len(held) == 6 * 7 // 2 and all(any({j, k} <= h for h in held.values()) for j in range(0, n, 97) for k in range(j))


def test_links_across_chunks_of_several_homes(spark):
    """Groups that overlap in their wording are linked as brute force links them, whatever the limits."""
    rng = np.random.default_rng(11)
    rows, base = [], [f"w{k}" for k in range(60)]
    for i in range(150):
        at = i // 3  # wording drifts, so that neighbours are alike and the ends are not
        rows.append((i, " ".join(base[at % 60 :] + base[: at % 60] + [f"d{k}" for k in rng.integers(0, 3, 2)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    for block, few in ((8, 0), (8, 1000), (128, 1000)):
        found = near_duplicates.near_duplicates(docs, block=block, texts_a_side=block // 2, broadcast_rows=few)
        assert rows_of(found.select("doc_id", "class_id", "n_links")) == want


def test_keep_one_of_odd_rows(odd_docs):
    kept = near_duplicates.keep_first_of_class(odd_docs, near_duplicates.near_duplicates(odd_docs))
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and 6 in ids and 7 not in ids


def test_keep_one_of_each_class_that_shares_an_id(spark):
    text = lambda k, n=30: " ".join(f"t{k}w{i}" for i in range(n))
    near = text(1, 40)
    rows = [
        (None, text(2)), (None, text(3)), (None, text(4)), (None, text(4)),  # unrelated texts without an id, one of them twice
        (5, text(5)), (5, text(6)), (6, text(6)),  # two texts with one id, one of them with a copy
        (None, None), (None, ""), (7, None), (7, "!!!"), (8, "..."),  # no words, so no links
        (9, near), (9, near + " more"), (10, near + " last"), (11, text(7)), (11, text(7)),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __id string")
    for broadcast_rows in (0, 1000):
        kept = near_duplicates.keep_first_of_class(docs, near_duplicates.near_duplicates(docs, broadcast_rows=broadcast_rows))
        assert kept.columns == docs.columns
        got = rows_of(kept.select("doc_id", "text"))
        group = [r for r in got if r[0] == 9]
        assert len(group) == 1 and group[0][1] in (near, near + " more")
        want = [(None, text(2)), (None, text(3)), (None, text(4)), (5, text(5)), (5, text(6)), (None, None), (None, ""), (7, None), (7, "!!!"), (8, "..."), (11, text(7))]
        assert [r for r in got if r[0] != 9] == sorted(want, key=repr)


def test_least_matches():
    for n in near_duplicates.STEPS:
        m = near_duplicates.least_matches(n, 0.8, 1e-6)
        assert 0 < m < 0.8 * n


# ---- decontamination


def test_masks_miss_no_two_substitutions():
    from itertools import combinations

    for wrong in combinations(range(decontamination.LEAST), 2):
        assert any(
            not any(at + p in wrong for p in mask) for mask in decontamination.MASKS for at in range(decontamination.LEAST - mask[-1])
        ), wrong
    for n in range(1, decontamination.LEAST):
        (mask,) = decontamination.masks_for(n)
        for wrong in combinations(range(n), int(n * 0.2 + 1e-9)):
            assert any(not any(at + p in wrong for p in mask) for at in range(n - mask[-1]))


def test_masks_miss_no_stretch():
    """All placements of all substitutions in 13 to 25 words; longer stretches hold one of these."""
    from itertools import combinations

    for n in range(decontamination.LEAST, 2 * decontamination.LEAST):
        wrong = np.array([sum(1 << p for p in c) for c in combinations(range(n), int(n * 0.2 + 1e-9))])
        missed = np.ones(len(wrong), bool)
        for mask in decontamination.masks_for(n):
            for at in range(n - mask[-1]):
                missed &= (wrong & sum(1 << at + p for p in mask)) != 0
        assert not missed.any(), n
    # other limits have one plain run, for the length that needs the shortest
    ((*run,),) = decontamination.masks_for(40, 13, 0.79)
    for n in range(13, 26):
        wrong = int(n * 0.21 + 1e-9)
        assert (n - wrong) > (len(run) - 1) * (wrong + 1)


def test_every_placement_is_found():
    from itertools import combinations

    for n, k in ((13, 2), (15, 3), (16, 3), (17, 3)):
        item = [f"v{i}" for i in range(n)]
        own, _ = decontamination.word_hashes([" ".join(item)])
        for wrong in combinations(range(1, n - 1), k):
            text = ["before", "it", *("x" if i in wrong else w for i, w in enumerate(item)), "after"]
            words, _ = decontamination.word_hashes([" ".join(text)])
            met = {(p, a) for m in decontamination.MASKS for a, x in enumerate(decontamination.seeds(own, m)) for p in np.flatnonzero(decontamination.seeds(words, m) == x)}
            assert {p - a for p, a in met} == {2} and decontamination.overlap(words, own, 2) == (2, 0, n, n - k), wrong


def test_longest_stretch_between_equal_words():
    def brute(same, least=13):
        n = len(same)
        if n <= least:
            return n if 5 * sum(same) >= 4 * n else 0
        return max([e - b for b in range(n) for e in range(b + least, n + 1) if same[b] and same[e - 1] and 5 * sum(same[b:e]) >= 4 * (e - b)], default=0)

    rng = np.random.default_rng(12)
    masks = [[0] * 3 + [1] * 12 + [0] * 8 + [1] * 6 + [0] * 2 + [1] * 5, [1] * 12 + [0] * 9 + [1] * 6 + [0] * 2 + [1] * 5 + [0]]
    masks += [(rng.random(n) < p).astype(int).tolist() for n in (5, 13, 16, 25, 40) for p in (0.6, 0.75, 0.85) for _ in range(40)]
    for same in masks:
        item = [f"v{i}" for i in range(len(same))]
        own, _ = decontamination.word_hashes([" ".join(item)])
        words, _ = decontamination.word_hashes([" ".join(w if s else "x" for w, s in zip(item, same))])
        found, want = decontamination.overlap(words, own, 0), brute(same)
        assert (found is not None) == (want > 0), same
        if found and len(same) > 13:
            start, at, n, equal = found
            assert start == at and (n, equal) == (want, sum(same[at : at + n])), same
        elif found:
            assert found[3] == sum(same)


def test_overlaps(spark, odd_docs, no_docs):
    rng = np.random.default_rng(8)
    words = lambda n: [f"v{k}" for k in rng.integers(0, 4000, n)]
    items = [(0, words(40)), (1, words(13)), (2, words(5)), (3, words(30))]
    long_, thirteen, five, other = (w for _, w in items)
    changed = list(long_)
    for at in range(4, 40, 9):
        changed[at] = "changed"
    docs = [
        (0, words(50) + long_ + words(9), {0}), (1, words(20) + changed, {0}), (2, thirteen, {1}), (3, words(3) + five + words(3), {2}),
        (4, words(80), set()), (5, words(4) + long_[:9] + words(4), set()), (6, words(5) + other[10:26] + words(5) + thirteen, {3, 1}), (7, [], set()),
    ]
    bench = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items] + [(9, None), (10, "...")], "item_id long, text string")
    table = spark.createDataFrame([(i, ", ".join(w)) for i, w, _ in docs], "doc_id long, text string")
    for few in (0, 1000):
        found = defaultdict(set)
        for r in decontamination.find_overlaps(table, bench, broadcast_rows=few).collect():
            found[r.doc_id].add(r.item_id)
        assert {i: found.get(i, set()) for i, _, _ in docs} == {i: s for i, _, s in docs}
    assert sorted(r.doc_id for r in decontamination.decontaminate(table, bench).collect()) == [4, 5, 7]
    clean = decontamination.decontaminate(odd_docs, bench)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    assert decontamination.find_overlaps(no_docs, bench).count() == 0
    assert decontamination.decontaminate(odd_docs, bench.limit(0)).count() == odd_docs.count()


def brute_overlaps(rows, items):
    """Every item laid on every document in every way."""
    found = {}
    for i, text in rows:
        w = WORD.findall((text or "").lower())
        for j, item in items:
            v = WORD.findall((item or "").lower())
            need, best = min(13, len(v)), None
            for shift in range(-len(v) + 1, len(w)):
                lo, hi = max(0, -shift), min(len(v), len(w) - shift)
                same = [w[p + shift] == v[p] for p in range(lo, hi)]
                if len(same) < need or sum(same) < 0.8 * need - 1e-9 or not any(same):
                    continue
                at = [k for k, s in enumerate(same) if s]
                fits = [(b - a + 1, -a) for x, a in enumerate(at) for y, b in enumerate(at[x:]) if b - a + 1 >= need and 5 * (y + 1) >= 4 * (b - a + 1)]
                if fits:
                    n, a = max(fits)
                    n, a = n, -a
                    key = (sum(same[a : a + n]), -(lo + a + shift), -(lo + a), n)
                elif len(v) <= 13 and 5 * len(at) >= 4 * len(v):
                    key = (len(at), -(lo + at[0] + shift), -(lo + at[0]), at[-1] - at[0] + 1)
                else:
                    continue
                best = max(best or key, key)
            if best:
                found[i, j] = (-best[1], -best[2], best[3], best[0])
    return found


def test_overlaps_against_brute_force(spark):
    rng = np.random.default_rng(23)
    word = lambda k: f"v{k}"
    items = [(j, " ".join(map(word, rng.integers(0, 60, n)))) for j, n in enumerate((40, 28, 22, 17, 15, 13, 9, 6, 4, 1))]
    rows = []
    for i in range(160):
        own = list(map(word, rng.integers(0, 60, rng.integers(0, 60))))
        taken = items[int(rng.integers(0, 9))][1].split()
        a = int(rng.integers(0, max(1, len(taken) - 12)))
        taken = taken[a : a + int(rng.integers(10, 41))]
        for at in range(len(taken)):
            if rng.random() < 0.16:
                taken[at] = "changed"
        own[len(own) // 2 : len(own) // 2] = taken
        rows.append((i, ". ".join(own)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_overlaps(rows, items)
    for few in (0, 10_000):
        got = {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.n_words, r.n_equal) for r in decontamination.find_overlaps(docs, bench, broadcast_rows=few).collect()}
        assert got == want
    assert len(want) > 80 and len({j for _, j in want}) >= 8


def test_common_passages_keep_their_overlaps(spark):
    """One passage in every item and document: every pair is found."""
    passage = " ".join(f"p{k}" for k in range(14))
    items = spark.range(40).select(F.col("id").alias("item_id"), F.concat(F.lit("i"), "id", F.lit(f" {passage} j"), "id").alias("text"))
    docs = spark.range(60).select((F.col("id") % 50).alias("doc_id"), F.concat(F.lit("d"), F.col("id") % 50, F.lit(f" {passage} and {passage}")).alias("text"))
    for few in (0, 10_000):
        assert decontamination.find_overlaps(docs, items, broadcast_rows=few).count() == 2000


# ---- fingerprints


def brute_edited(docs):
    """Every text beside its edited one, and their likeness by fingerprints that are made one by one."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    mark = lambda t: fingerprints.fingerprints([t])
    out = []
    for r, behind in zip(rows, rows[1:] + rows[:1]):
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + behind.text[:half]
        near = [round(float(fingerprints.likeness(mark(r.text), mark(t))[0]), 9) for t in (edited, behind.text)]
        own = [fingerprints.to_text(mark(t))[0] for t in (r.text, edited)]
        out.append((str(r.doc_id), len(r.text), hashlib.sha256(edited.encode()).hexdigest(), *own, *near))
    return sorted(out)


def edited_rows(found):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found.collect())


def test_edited_texts_of_hot_ids(spark):
    """Ids that many texts share, null ids among them, are split over ranges, and every text has its next one."""
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"line {k} of some words {k * k}\nand more {k % 7}") for k in range(240)]
    rows += [((1 << 62) + k, f"far away {k}") for k in range(3)] + [(-(1 << 62), "at the other end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_edited(docs)
    for n in (1, 7, 30):
        assert edited_rows(fingerprints.compare_edited(docs, ranges=n)) == want
    sizes = ranges.sized(docs, "doc_id", "text")
    plan = ranges.plan_ranges(sizes, 30)
    dealt = ranges.place_rows(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")), plan, F.col("h")).collect()
    assert max(Counter(r.bucket for r in dealt).values()) <= 3 * len(rows) / 30 and max(r.bucket for r in dealt) < plan[-1]
    in_order = sorted(dealt, key=lambda r: (r.bucket, r.id is not None, r.id or 0))
    assert [r.id for r in in_order] == sorted((r.id for r in dealt), key=lambda i: (i is not None, i or 0))


def test_ranges_of_bytes(spark):
    """Ranges hold nearly equal bytes where ids are dense, far apart, or both."""
    rng = np.random.default_rng(2)
    ids = [*range(1000, 3000), *rng.integers(-(1 << 63), (1 << 63) - 1, 300).tolist(), -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(int(i), 100 + int(i) % 50) for i in ids], "id long, size long")
    plan = ranges.plan_ranges(rows, 20)
    dealt = ranges.place_rows(rows, plan, F.xxhash64("id")).collect()
    size = Counter()
    for r in dealt:
        size[r.bucket] += r["size"]
    share = sum(size.values()) / 20
    assert max(size.values()) <= 3 * share and len(size) >= 12
    order = sorted(dealt, key=lambda r: (r.bucket, r.id))
    assert [r.id for r in order] == sorted(ids)


def test_edited_texts(odd_docs, no_docs):
    assert edited_rows(fingerprints.compare_edited(odd_docs)) == brute_edited(odd_docs)
    order = sorted(((r.doc_id, r.text or "", r.h) for r in odd_docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()), key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))
    texts = [t for _, t, _ in order]
    nexts = texts[1:] + texts[:1]
    want = sorted(
        (str(i), len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for (i, t, _), n in zip(order, nexts)
    )
    for n in (1, 4):
        found = fingerprints.compare_edited(odd_docs, ranges=n).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert fingerprints.compare_edited(no_docs).count() == 0


def test_fingerprints_add_up():
    text = "one two three four\nfive six seven\none two three four\n\nlast line here"
    (whole,) = fingerprints.fingerprints([text])
    assert (fingerprints.fingerprints(["\n".join(reversed(text.split("\n")))])[0] == whole).all()
    shorter = fingerprints.delete(whole, "one two three four")
    assert (shorter == fingerprints.fingerprints(["one two three four\nfive six seven\nlast line here"])[0]).all()
    assert (fingerprints.insert(shorter, "one two three four") == whole).all()
    assert (fingerprints.from_text(fingerprints.to_text(whole[None])[0]) == whole).all()
    other = fingerprints.fingerprints(["one two three four\nfive seven six\none two three four\nlast line here"])
    assert (other[0] != whole).any() and 0.5 < fingerprints.likeness(whole[None], other)[0] < 1
    blank = fingerprints.fingerprints([None, ""])
    assert not blank.any() and fingerprints.likeness(blank[:1], blank[1:])[0] == 1 and fingerprints.likeness(blank[:1], whole[None])[0] == 0


# ---- licenses


def test_licenses(spark, odd_docs, no_docs):
    templates = licenses.template_table(spark)
    fill = " ".join(f"u{k}" for k in range(40))
    texts = [(k, f"{fill}\n{t[2].upper()}.\n{fill}", t[0]) for k, t in enumerate(licenses.TEMPLATES)]
    texts += [(90, fill, None), (91, None, None), (92, "Released under the terms", None), (93, "Released under the MIT License", "mit-line")]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in texts], "doc_id long, text string, at int")
    found = defaultdict(set)
    for r in licenses.scan_licenses(docs, templates).collect():
        found[r.doc_id].add(r.template)
        assert r.containment >= 0.8
    assert all(want in found[i] for i, _, want in texts if want) and not any(found.get(i) for i, _, want in texts if not want)
    assert licenses.scan_licenses(odd_docs, templates).count() == 0 == licenses.scan_licenses(no_docs, templates).count()
    assert licenses.scan_licenses(docs, templates.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, spark.createDataFrame([("t", "l", "too short")], "template string, license string, text string"))


def test_short_licenses_in_any_surroundings(spark):
    """A template of one shingle lies in one window only, whatever stands beside it."""
    templates = licenses.template_table(spark)
    word = lambda k: F.concat(F.lit("u"), F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(100_000)))
    line = F.when(F.col("doc_id") % 2 == 0, "Released under the MIT License").otherwise("Licensed under CC BY 4.0")
    before = F.slice(F.array(*[word(k) for k in range(8)]), F.lit(1), (F.col("doc_id") % 8).cast("int") + 1)
    text = F.concat_ws(" ", before, line, *[word(k) for k in range(8, 16)])
    docs = spark.range(8000).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"))
    found = licenses.scan_licenses(docs, templates).groupBy("template").count().collect()
    assert {r["template"]: r["count"] for r in found} == {"mit-line": 4000, "cc-by-line": 4000}


def test_bands_retrieve_at_the_stated_probability(spark):
    """A shingle beside a random one shares each band half of the time, and misses k of them 2**-k of the time."""
    n, bands = 20_000, 8
    pairs = spark.range(n).select(F.xxhash64(F.lit(1), "id").alias("h0"), F.xxhash64(F.lit(2), "id").alias("h1"))
    same = F.array(*[licenses._band(k, [F.col("h0"), F.col("h1")]) == licenses._band(k, [F.col("h0")]) for k in range(bands)])
    rows = pairs.select(F.size(F.filter(same, lambda x: x)).alias("n")).groupBy("n").count().collect()
    seen = {r.n: r["count"] for r in rows}
    assert abs(sum(k * c for k, c in seen.items()) / (n * bands) - 0.5) < 0.01
    assert abs(seen.get(0, 0) - n / 2**bands) < 4 * (n / 2**bands) ** 0.5


def test_whole_license_texts(spark):
    """A whole text is found in other surroundings, also where a few words differ, and in blocks of any size."""
    templates = licenses.template_table(spark)
    fill = " ".join(f"u{k}" for k in range(30))
    texts = [(k, f"{fill}\n{text}\n{fill}", name) for k, (name, _, text) in enumerate(licenses.TEMPLATES) if name.endswith("-text")]
    changed = licenses.MIT_TEXT.replace("portions", "parts").replace("substantial", "large")
    texts += [(90, f"Copyright (c) Somebody\n\n{changed}", "mit-text"), (91, licenses.MIT_TEXT[: len(licenses.MIT_TEXT) // 2], None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    for words in (300, 10_000):
        found = defaultdict(set)
        for r in licenses.scan_licenses(docs, templates, block_words=words).collect():
            found[r.doc_id].add(r.template)
        assert all(want in found[i] for i, _, want in texts if want) and "mit-text" not in found[91]


# ---- quality


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    held = quality.score_documents(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in held) / len(held) > 0.97


def test_runs_fit_the_same_classifier(spark):
    """Repeated ids and rows, in any order and number of partitions, give one model."""
    docs = spark.createDataFrame([(k % 40, f"text number {k % 60} with words {'!' * (k % 7)} {k % 3}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    models = [quality.train(d, labels, rows=30) for d in (docs, docs.orderBy(F.rand(3)).repartition(7), docs.unionByName(docs))]
    for m in models[1:]:
        assert (m.weights == models[0].weights).all() and m.bias == models[0].bias and m.rate == models[0].rate


def brute_scores(docs, model, threshold=0.5):
    """Evidence, group means by moments, and every document's posterior, in plain numbers."""
    rows = docs.select("doc_id", "text", "source", "lang").collect()
    logit = model.logits(quality.features([r.text for r in rows]))
    p = 1 / (1 + np.exp(-logit))
    total = (p.sum() + model.rate) / (len(p) + 1)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[r.source, r.lang].append(k)
        groups[r.source].append(k)
    hosts = [g for g in groups if not isinstance(g, tuple)]
    paths = [g for g in groups if isinstance(g, tuple)]

    def strength(names, prior):
        n = np.array([len(groups[g]) for g in names], float)
        m = np.array([p[groups[g]].mean() for g in names])
        q = np.array([prior(g) for g in names])
        if len(names) < 2:
            return 10.0
        within, whole = (n * m * (1 - m)).sum() / n.sum(), (n * q * (1 - q)).sum() / n.sum()
        spread = ((n * (m - q) ** 2).sum() - (len(n) - 1) * within) / max(1.0, n.sum() - (n**2).sum() / n.sum())
        return float(min(1e4, max(1.0, whole / spread - 1))) if spread > 0 else 1e4

    a = strength(hosts, lambda g: total)
    host = {g: (p[groups[g]].sum() + a * total) / (len(groups[g]) + a) for g in hosts}
    b = strength(paths, lambda g: host[g[0]])
    out = []
    base = np.log(model.rate / (1 - model.rate))
    for k, r in enumerate(rows):
        own = groups[r.source, r.lang]
        path = (sum(p[j] for j in own if j != k) + b * host[r.source]) / (len(own) - 1 + b)
        path = min(max(path, 1e-4), 1 - 1e-4)
        score = 1 / (1 + np.exp(-(logit[k] - base + np.log(path / (1 - path)))))
        out.append((str(r.doc_id), round(p[k], 9), round(host[r.source], 9), round(path, 9), round(score, 9), bool(score >= threshold)))
    return sorted(out)


def test_posteriors_against_brute_force(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.train(docs, labels)
    # one large host and many sparse ones, and a null one
    more = docs.withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("h"), "doc_id")).when(F.col("doc_id") % 7 > 0, "hot"))
    for table in (docs, more, odd_docs):
        found = quality.score_documents(table, model).collect()
        got = sorted((str(r.doc_id), round(r.evidence, 9), round(r.host_quality, 9), round(r.path_quality, 9), round(r.score, 9), r.keep) for r in found)
        want = brute_scores(table, model)
        for x, y in zip(got, want, strict=True):
            assert x[0] == y[0] and x[5] == y[5] and np.allclose(x[1:5], y[1:5], rtol=1e-6, atol=1e-8), (x, y)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (6, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    scores = quality.score_documents(odd_docs, model)
    assert scores.count() == odd_docs.count() and scores.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.keep_good(odd_docs, scores).columns == odd_docs.columns
    assert quality.score_documents(no_docs, model).count() == 0
    blank = quality.train(odd_docs, labels.limit(0))
    assert blank.rate == 0.5 and quality.score_documents(odd_docs, blank).count() == odd_docs.count()
