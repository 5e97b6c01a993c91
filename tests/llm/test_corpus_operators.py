"""Top-k, WARC, Jaccard join, suffix dedup, mixing, pipeline: against brute force, and their edge cases."""

import gzip
import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import jaccard, mixing, secrets, suffixes, topk, warc
from textloom.llm._common import scratch


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k(spark, block):
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, 0.25, 0.5, 2.0]) for _ in range(4)]) for i in range(200)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + [(300, [0.5] * 4)]  # ties and a repeated row
    odd = [(400, None), (450, []), (500, [1.0, None, 1.0, 1.0]), (550, [float("nan")] * 4), (600, [float("inf"), 1.0, 1.0, 1.0]), (650, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(6)
    v = topk.quantized(df, "vec_id", "embedding")
    got = topk.top_k(v, v.where(F.col("id") % 50 == 0), 5, block).collect()
    fine = [(i, [math.floor(256 * x) for x in e]) for i, e in rows]
    want = set()
    for q, e in {(i, tuple(e)) for i, e in fine if i % 50 == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in fine if i != q))
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])}
    assert {(x.query_id, x["rank"], x.id, x.score) for x in got} == want
    assert {x.query_id for x in got} == {0, 50, 100, 150, 300, 350}
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0
    few = v.where("id < 3 AND id IS NOT NULL")
    assert topk.top_k(few, few, 5).count() == 6


def test_warc(spark):
    big, other = "x" * 150, "é" * 60
    rows = [(5, "http://a/ b\n", big), (3, None, big), (9, "u", big), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (7, "u", ""), (8, "ü", other), (6, "q", other), (10, "u", "long " * 50000), (None, "n", big)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "page_id long, url string, html string, digest string").repartition(4)
    runs = []
    for _ in range(2):
        folder = scratch(spark, "warc")
        manifest = warc.write(df, folder, 3, roll=600)
        runs.append(sorted((m.name, m.sha256, m.records) for m in manifest.collect()))
        got = {x.page_id: x for x in warc.read(manifest, folder).collect()}
    assert runs[0] == runs[1] and sum(x[2] for x in runs[0]) == len(rows) and len(runs[0]) > 3
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None] if len(raw) >= 100 else [page]
        want = ("response", None) if page == min(same) else ("revisit", min(same))
        x = got[page]
        assert (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), *want)
    folder = scratch(spark, "warc")
    assert warc.read(warc.write(df.limit(0), folder), folder).count() == 0


def test_warc_files_do_not_depend_on_how_rows_lie(spark):
    html = F.concat(F.repeat(F.lit("<p>"), (F.col("page_id") % 7).cast("int")), F.sha2((F.col("page_id") % 90_001).cast("string"), 256), F.lit("x" * 60))
    pages = spark.range(100_000).select((F.col("id") * 13 % 100_003).alias("page_id")).select("page_id", F.lit("u").alias("url"), html.alias("html"))
    pages = pages.union(pages.where("page_id < 50"))  # repeated rows
    runs = []
    for n in (3, 11):
        folder = scratch(spark, "warc")
        manifest = warc.write(pages.repartition(n), folder, 6, roll=1 << 20)
        runs.append(sorted((m.name, m.sha256, m.records) for m in manifest.collect()))
    assert runs[0] == runs[1] and len(runs[0]) > 12 and sum(x[2] for x in runs[0]) == 100_050
    out = warc.read(manifest, folder)
    assert out.rdd.getNumPartitions() > 1 and out.count() == 100_050
    path = folder.removeprefix("file:")
    heads = [h for m in manifest.collect() for h, _ in warc.records(gzip.open(f"{path}/{m.name}"))]
    assert len({h["warc-record-id"] for h in heads}) == len(heads) == 100_050 + len(runs[0])


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in where[g]:
                common[j] += 1
            where[g].append(k)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((find(i), find(sets[j][0])))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed=4):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 6, 8, 9, 10, 12, 20, 40, 100, 300]))]
        for _ in range(r.choice([1, 2, 5, 30])):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                p = r.randrange(len(t))
                t[p] = r.choice(vocabulary) if r.random() < 0.7 else t[p].upper()
            rows.append(" ".join(t[: max(1, len(t) - (r.randint(0, len(t) // 8 + 1) if r.random() < 0.3 else 0))]))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_jaccard_join(spark):
    rows = near_copies() + [(5000, None), (5001, ""), (5002, " \n")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, rows[0][1], 1)], "doc_id long, text string, n_shingles int").repartition(4)
    out = jaccard.near_duplicates(df).collect()
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in out}
    assert got.pop(None) == (len(shingles(rows[0][1])), None)
    assert got == classes(rows) and len(out) == len(rows) + 1
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    two = [(1, "a b c d e f g"), (1, "k l m n o p q"), (2, "K l m n o p q"), (3, "a b c d e f g")]
    out = jaccard.near_duplicates(spark.createDataFrame(two, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1)]


@pytest.fixture(params=[8, jaccard.DEEP])
def deep(request, monkeypatch):
    """Signatures with both ways of cutting parts at work in small sets."""
    monkeypatch.setattr(jaccard, "DEEP", request.param)
    jaccard.bands.cache_clear()
    yield
    monkeypatch.undo()
    jaccard.bands.cache_clear()


@pytest.mark.parametrize("seed", range(300))
def test_linked_sets_share_a_signature_and_pass_the_filters(deep, seed):
    g = np.random.default_rng(seed)
    common = int(g.integers(1, 60) if seed % 2 else g.integers(1, 3000))
    only_a, only_b = (int(x) for x in g.integers(0, max(2, common // 6), 2))
    x = np.unique(g.integers(0, 2**64, common + only_a + only_b, dtype=np.uint64))
    g.shuffle(x)
    a, b = np.sort(x[: common + only_a]), np.sort(np.concatenate([x[:common], x[common + only_a :]]))
    if not jaccard.linked(a, b) or np.array_equal(a, b):
        return
    s, whose = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert set(s[whose == 0].tolist()) & set(s[whose == 1].tolist())
    assert jaccard.possible(len(a), len(b), jaccard.bitmap(a), jaccard.bitmap(b))


def cut(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                m[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        out.append((i, len(b), sum(m), sum(m[j] and (j == 0 or not m[j - 1]) for j in range(len(m))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4 << 20, 8 << 20), (500, 900)])
def test_suffix_dedup(spark, sizes):
    r = random.Random(2)
    parts = ["alpha", "be", "gamma delta", "x" * 70, "été", "of the", "\0\0", "zz"]
    base = ["".join(r.choice(parts) + " " for _ in range(r.randint(1, 60))) for _ in range(20)]
    rows = []
    for i in range(150):
        t = "".join(b[r.randint(0, len(b) // 2) :][: r.randint(1, 200)] for b in r.sample(base, 3)) if i % 3 else "".join(r.choice("ab") for _ in range(r.randint(0, 300)))
        rows.append((i * 7 % 307, t))
    rows += [(1000, None), (1001, ""), (1002, "\0" * 200), (1003, "\0" * 60), (1004, "q" * 5000), (1005, "q" * 49), (1006, "q" * 50), (1006, "q" * 50), (1004, "q" * 80)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_bytes int").repartition(5)
    got = suffixes.dedup_digest(df, *sizes).collect()
    assert sorted(map(tuple, got)) == cut(rows)
    assert suffixes.dedup_digest(df.limit(0)).count() == 0
    alone = suffixes.dedup_digest(spark.createDataFrame([(None, "q" * 60), (1, "q" * 60)], "doc_id long, text string")).collect()
    assert all(x.n_removed == 0 for x in alone) and len(alone) == 2


def shares(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def test_mix(spark):
    r = random.Random(7)
    rows = [(i, r.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"]), r.choice([0, 5, 5, 5, 40, 900])) for i in range(3000)]
    rows += [(9000, "tiny", 1), (9001, "zero", 0), (None, "a", 5), (None, "a", 5), (17, "hot", 5), (17, "hot", 5)]
    df = spark.createDataFrame([(*x, "t") for x in rows], "doc_id long, source string, size long, target string").repartition(7)
    runs = [sorted(map(str, mixing.mix(x, bucket_rows=50).collect())) for x in (df, df.repartition(3))]
    assert runs[0] == runs[1]
    out = mixing.mix(df, bucket_rows=50).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    want = shares(sizes)
    taken = defaultdict(int)
    for x in out:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source]) and 0 <= x.copies <= 3
        taken[x.source] += x.copies * x.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 40 or s == "tiny", s
    assert mixing.mix(df.limit(0)).count() == 0


def plain_copies(rows, seed=mixing.SEED):
    """Copies taken of each (source, size), by walking over a source's documents one by one."""
    sizes, by = defaultdict(int), defaultdict(list)
    for _, s, n in rows:
        sizes[s] += n
        by[s].append(n)
    target, out = shares(sizes), defaultdict(int)
    for s, all_sizes in by.items():
        level = lambda n, s=s: next((i for i, part in enumerate(mixing.LEVELS) if n * part > target[s]), len(mixing.LEVELS))
        left, taken, total, offset = sizes[s], 0, 0.0, OFFSETS[s]
        for i in range(len(mixing.LEVELS) + 1):
            mine = sorted((n for n in all_sizes if level(n) == i), reverse=True)
            rate = max(0.0, min(3.0, (target[s] - taken) / left)) if left else 0.0
            for n in mine:
                crossed = math.floor(total + rate + offset + 1e-9) - math.floor(total + offset + 1e-9)
                total += rate
                out[s, n] += crossed
                taken += n * crossed
            left -= sum(mine)
    return {k: v for k, v in out.items() if v}


OFFSETS = {}


def test_mix_against_a_plain_sampler(spark):
    r = random.Random(17)
    rows = [(i, r.choice(["a", "b", "hot", "hot", None]), int(r.paretovariate(0.8) * 3) % 4000) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    OFFSETS.update({x.source: x.o for x in df.select("source", mixing._offset("source", mixing.SEED).alias("o")).distinct().collect()})
    got = defaultdict(int)
    for x in mixing.mix(df, bucket_rows=7).collect():
        got[x.source, x.size] += x.copies
    assert {k: v for k, v in got.items() if v} == plain_copies(rows)


def test_tables_are_deleted(spark, tmp_path):
    from textloom.llm import _common

    df = spark.range(3)
    with _common.temporary(spark):
        with _common.temporary(spark):
            a, b = _common.materialize(df, "a"), _common.materialize(df, "b", result=True)
            assert a.count() == 3
        assert b.count() == 3
        with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
            a.count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        b.count()


def test_mix_takes_long_documents_at_their_rate(spark):
    # source a: rate 0.45, and without its long document the taken words are nearer to the target
    rows = [(0, "a", 20000)] + [(1 + i, "a", 1000) for i in range(10)] + [(100 + i, "b", 1050) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").coalesce(1).cache()
    seeds = range(6)
    taken = [mixing.mix(df, seed=s).where("doc_id = 0").first().copies for s in seeds]
    assert 0 < sum(taken) < len(seeds)


def test_pipeline(spark):
    import corpus_pipeline as p

    prose = lambda seed: " ".join("".join(random.Random(f"{seed}-{i}").choices("abcdefghij", k=random.Random(f"{seed}{i}").randint(3, 7))) for i in range(80)) + "."
    docs = [(i, prose(i), "en", f"s{i % 3}", 0, "x") for i in range(30)]
    docs += [(100 + i, prose(i) + " more", "en", "s0", 0, "x") for i in range(5)] + [(200, "too short", "en", None, 0, "x"), (201, None, None, None, None, "x")]
    docs += [(None, prose(300), "en", None, 0, "x"), (301, prose(301) + " password = hunter2hunter2", "en", "s1", 0, "x"), (29, prose(29), "en", "s2", 0, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    kept = p.quality_rules(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {200, 201}
    one = p.near_duplicates(spark, kept, "")
    assert one.columns == df.columns and sorted(str(r.doc_id) for r in one.collect()) == sorted(map(str, [*range(30), 29, None, 301]))
    safe = p.secret_scan(spark, one, "")
    assert safe.columns == df.columns and [r.text for r in safe.collect() if r.doc_id == 301] == [prose(301) + " [assign]"] and safe.count() == one.count()
    assert secrets.spans(prose(301), secrets._encoding(*secrets.vocabulary())) == []
    mixed = p.mix_sources(spark, safe, "").collect()
    sized = safe.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    want = mixing.mix(sized).where("copies > 0").collect()
    assert len(mixed) == sum(r.copies for r in want) and mixed[0].asDict().keys() == set(df.columns)
    tokens = p.bpe_encode(spark, p.mix_sources(spark, safe, ""), "").collect()
    assert len(tokens) == len(mixed) and all(len(t.ids) == t.n_tokens for t in tokens)
    empty = df.limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
