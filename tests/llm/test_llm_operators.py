"""Operators against slow plain versions, on fixtures with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import functools
import itertools
import math
import random
import re
import zlib

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bytescan, chat, components, decontaminate, mixing, multi_index, near_dedup, queries, records, run_length_index, substring_dedup, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "Ru", "é") for b in ("ta", "so", "vi", "x.", "ü")]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def fixture():
    rng = random.Random(4)
    docs = [(i, words(rng, rng.randint(0, 120))) for i in range(40)]
    passage = words(rng, 70)
    docs += [(100 + i, f"{words(rng, 20)}\n{passage}\t{words(rng, 10)}") for i in range(12)]
    docs += [(200 + i, docs[20 + i][1]) for i in range(6)]
    docs += [
        (300, None), (301, ""), (302, " \n\t "), (303, "\u3000한 국 어 日本"), (304, words(rng, 30_000)), (None, passage), (None, None), (5, docs[5][1]),
        (5, docs[6][1]), (305, "a" * 5000), (306, passage * 3), (307, "<|endoftext|> x")
    ]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    # Other columns have names that the operators use inside.
    return spark.createDataFrame([(i, t, None, "k", 1.5) for i, t in fixture()], "doc_id long, text string, key string, doc string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()), key=repr)


def test_substring_dedup(docs, empty):
    got = rows(substring_dedup.dedup(docs, span=20))
    assert got == sorted(brute.substring_dedup(fixture(), 20), key=repr)
    assert sum(r[2] > 0 for r in got) > 10
    assert substring_dedup.dedup(empty).collect() == []


@pytest.mark.parametrize("limits", [{}, {"hot_bytes": 2000}, {"hot_bytes": 300, "bucket_bytes": 1000}])
def test_run_length_index(docs, empty, limits, monkeypatch):
    monkeypatch.setattr(run_length_index, "removal_intervals", functools.partial(run_length_index.removal_intervals, **limits))
    got = rows(run_length_index.dedup(docs, span=60))
    assert got == sorted(brute.byte_repeats(fixture(), 60), key=repr)
    assert run_length_index.dedup(empty).collect() == []


def test_run_length_index_of_many_equal_rows(spark):
    rng = random.Random(17)
    long_text, short_text = words(rng, 2400)[:10_000], words(rng, 90)
    once = [(1, long_text), (2, short_text), (None, short_text), (None, long_text[:3000]), (3, words(rng, 400)), (4, None)]
    many = {(1, long_text): 1000, (2, short_text): 300, (None, short_text): 300, (4, None): 50}
    frame = spark.createDataFrame([r for r in once for _ in range(many.get(r, 1))], "doc_id long, text string").repartition(6)
    # Further copies change nothing for any row, so the plain version needs two of each.
    plain = brute.byte_repeats([r for r in once for _ in range(min(2, many.get(r, 1)))])
    want = collections.Counter(plain)
    for i, text in many:
        digest = [r for r in want if r[0] == i and r[1] == len((text or "").encode())]
        assert len(digest) == 1 and want[digest[0]] == 2
        want[digest[0]] = many[i, text]
    assert collections.Counter(rows(run_length_index.dedup(frame))) == want
    assert sum(n for r, n in want.items() if r[2]) > 1500


@pytest.mark.parametrize("n", [5000, (1 << 21) + 10])
def test_suffix_array_of_any_size(n):
    codes = np.random.default_rng(3).integers(1, 9, n).astype(np.uint8)
    codes[n // 2 :] = codes[: n - n // 2]  # half of it repeats
    order = run_length_index.suffix_array(codes)
    raw = codes.tobytes()
    assert (np.sort(order) == np.arange(n)).all()
    at = np.linspace(0, n - 2, 400).astype(int)
    assert all(raw[order[i] :] < raw[order[i + 1] :] for i in at)


def test_matching_statistics():
    rng = random.Random(2)
    for n in (1, 2, 30, 200):
        codes = np.array([rng.randint(1, 3) for _ in range(n)] + [0], np.uint8)
        text = bytes(codes)
        assert list(run_length_index.suffix_array(codes)) == sorted(range(n + 1), key=lambda i: text[i:])
        index = run_length_index.RunLengthIndex(codes)
        assert sum(index.lengths) == n + 1
        want = [max((k for k in range(1, n + 2 - i) if text.find(text[i : i + k]) != i or text.find(text[i : i + k], i + 1) >= 0), default=0) for i in range(n + 1)]
        assert list(index.matching_statistics()) == want


def test_decontaminate(spark, docs, empty):
    texts = dict(fixture()[:40])
    items = [(1, " ".join(texts[3].split()[5:25])), (2, texts[7].upper()), (3, "kata"), (4, ""), (None, " ".join(texts[9].split()[:12])), (1, "kata LOSO!"), (6, None)]
    bench = spark.createDataFrame([(i, t, "t") for i, t in items], "item_id long, text string, doc_id string")
    want = sorted(brute.decontaminate(fixture(), items), key=repr)
    assert rows(decontaminate.scan(docs, bench)) == want
    assert rows(decontaminate.scan(docs, bench, block_chars=300)) == want
    assert not any(r["contaminated"] for r in decontaminate.scan(docs, bench.filter("false")).collect())
    assert decontaminate.scan(empty, bench).collect() == []
    clean = rows(decontaminate.keep_clean(docs, bench, block_chars=300))
    assert collections.Counter(r[0] for r in clean) == collections.Counter(r[0] for r in want if not r[5])
    spans = decontaminate.scan(docs, bench, with_spans=True).filter("doc_id = 3").first()["spans"]
    raw = texts[3].encode()
    assert any(decontaminate.normalised(items[0][1].encode()) == decontaminate.normalised(raw[s["start"] : s["end"]]) for s in spans)


def test_records(docs, empty, tmp_path):
    path = queries.tokenizer_path()
    got = records.encode(docs, path, f"file://{tmp_path}/r", shard_bytes=20_000)
    plain = brute.records(fixture(), path)
    # Rows with equal ids come in the order of a hash, so those are compared as sets of contents.
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    have = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()]
    assert sorted((key(r)) for r in have) == sorted((key(r)) for r in plain)
    unique = {i for i, n in collections.Counter(d[0] for d in fixture()).items() if n == 1}
    assert {r for r in have if r[0] in unique} == {r for r in plain if r[0] in unique}
    have.sort(key=lambda r: r[1])
    assert [r[1] for r in have] == list(np.cumsum([0] + [r[2] for r in have[:-1]]))
    index = docs.sparkSession.read.parquet(f"file://{tmp_path}/r/index").collect()
    for r in index[:10]:
        data = (tmp_path / "r/shards" / r["shard"]).read_bytes()
        doc_id, ids, end = records.read_record(data, r["offset"])
        assert doc_id == r["doc_id"] and len(ids) == r["n_tokens"] and end == r["offset"] + r["length"]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
    with pytest.raises(ValueError, match="damaged"):
        records.read_record(data[:20] + bytes([data[20] ^ 1]) + data[21:], 0)
    assert records.encode(empty, path, f"file://{tmp_path}/e").collect() == []


def test_pieces_are_the_tokenizers():
    t = records.PieceTokenizer(queries.tokenizer_path())
    rng = random.Random(3)
    texts = [
        "", " ", "a  b", "don't 've", "日本 語 の\u3000テ é à", "x\u00a0y \u2028 z",
        *("".join(rng.choice(list(" \n\t\u00a0\u3000ab1'é語<|.")) for _ in range(rng.randint(0, 60))) for _ in range(400))
    ]
    for _ in range(2):  # the second time from the cache
        assert [list(x) for x in t.encode([x.encode() for x in texts])] == [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_toxicity(spark, empty):
    rng = random.Random(9)
    made = []
    for i in range(900):
        toxic = rng.random() < 0.2
        text = words(rng, 40).split()
        if toxic:
            text[rng.randrange(40)] = rng.choice(["vile", "nasty"])
        made.append((i, " ".join(text), int(toxic)))
    table = spark.createDataFrame([(i, t) for i, t, _ in made] + [(None, "vile"), (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in made] + [(None, 1, None), (3, None, None), (99999, 1, None)], "doc_id long, toxic int, score string")
    model = toxicity.train(table, labels)
    got = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    held = [(i, y) for i, _, y in made if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} - {1000, 1001} == {i for i, _ in held}
    assert sum(got[i]["predicted"] == y for i, y in held) / len(held) > 0.95
    assert got[1000]["score"] == got[1001]["score"] and 0 <= got[1000]["score"] < 0.3
    # Held-out labels change nothing.
    again = toxicity.train(table, labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert np.array_equal(model.weight, again.weight) and len(model.place) < 2000
    kept = toxicity.keep_clean(table, model)
    assert kept.columns == table.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())
    assert toxicity.score(empty, model).collect() == []
    none = toxicity.train(table, labels.filter("false"))
    assert {r["score"] for r in toxicity.score(table, none).collect()} == {0.0}


def test_near_duplicates(spark, empty):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(30)]
    made = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(60):  # a large group of edited copies of one text, and some of others
        b = list(base[0] if i < 45 else base[i % 30])
        for _ in range(3):
            b[rng.randrange(200)] = rng.choice(vocabulary)
        made.append((100 + i, " ".join(b)))
    made += [(300, made[4][1]), (301, made[4][1].upper()), (302, ""), (303, ""), (304, None), (305, "w1 w2"), (306, "w1 w2 w3")]
    table = spark.createDataFrame([(i, t, "n", 1) for i, t in made], "doc_id long, text string, node string, h int")
    want = brute.near_classes(made, brute.idf_weights(made))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(table).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert sum(r["kept"] for r in got.values()) == len(set(want.values()))
    again = near_dedup.classes(table, small=2)
    assert {r["doc"]: r["label"]["doc"] for r in again.collect()} == want
    kept = near_dedup.keep_one(table)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert near_dedup.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "x y"), (1, "x y")], "doc_id long, text string")
    assert near_dedup.keep_one(odd).count() == 2


def test_near_duplicates_in_large_buckets(spark):
    # Pages of one template, each below the threshold to all others but its planted twin: most pairs meet in large buckets only.
    rng = random.Random(9)
    template = " ".join(f"t{i}" for i in range(350))
    made = []
    for i in range(60):
        own, other = ([f"u{i}x{rng.randrange(10**9)}" for _ in range(n)] for n in (46, 30))
        made.append((i, f"{template} {' '.join(own)}"))
        if i < 50:
            made.append((100 + i, f"{template} {' '.join(own[:16] + other)}"))
    want = brute.near_classes(made, brute.idf_weights(made))
    assert len(set(want.values())) == 60 and all(want[100 + i] == i for i in range(50))
    table = spark.createDataFrame(made, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(table).collect()} == want


def test_prefixes_that_reach_no_partner_go_and_no_pair_is_lost(spark):
    """Random prefix rows with hot shingles: after `_reaching` the same pairs can reach the threshold as before, and a family of equal sizes meets no more."""
    pick, t = random.Random(11), near_dedup.THRESHOLD
    rows = []
    for i in range(300):
        total = 100 * 1.5 ** pick.uniform(0, 6)
        rows += [(pick.randrange(12), (i, i), total, total * pick.uniform(t, 1)) for _ in range(3)]
    rows = list({(r[0], r[1]): r for r in rows}.values()) + [(99, (1000 + i, 0), 100.0 + i % 7, 82.0) for i in range(50)] + [(98, (5000, 0), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "shingle long, node struct<doc: long, h: long>, total double, rest double")

    def pairs(held):
        return {
            (a[0], a[1], b[1]) for a in held for b in held
            if a[0] == b[0] and a[1] < b[1] and min(a[3], b[3]) * (1 + t) >= (a[2] + b[2]) * (t * (1 - near_dedup.SLACK))
        }

    left = [(r["shingle"], tuple(r["node"]), r["total"], r["rest"]) for r in near_dedup._reaching(df, t).collect()]
    assert set(left) <= set(rows) and len(left) == len(set(left)) < len(rows)
    assert pairs(left) == pairs(rows) != set() and not [r for r in left if r[0] in (98, 99)]


def test_sizes_near_a_shingles_own_make_no_rows(spark):
    """The least partner is found among a shingle's own rows: nothing is repeated for the sizes around, and shingles of one text go."""
    pick, t, steps = random.Random(12), near_dedup.THRESHOLD, near_dedup.SIZE_STEPS
    rows = []
    for i in range(400):
        total = 10 * 1.5 ** pick.uniform(0, 9)
        rows += [(at, (i, i), total, total * pick.uniform(t, 1)) for at in pick.sample(range(60), 2)] + [(1000 + i, (i, i), total, total)]
    df = spark.createDataFrame(rows, "shingle long, node struct<doc: long, h: long>, total double, rest double")
    size = {r[2]: math.floor(math.log(r[2]) * steps / -math.log(t)) for r in rows}
    want = set()
    for r in rows:
        near = [x[2] for x in rows if x[0] == r[0] and abs(size[x[2]] - size[r[2]]) <= steps + 1]
        if len(near) > 1 and r[3] * (1 + t) >= (r[2] + min(near)) * (t * (1 - near_dedup.SLACK)):
            want.add(r)
    reaching = near_dedup._reaching(df, t)
    assert {(r["shingle"], tuple(r["node"]), r["total"], r["rest"]) for r in reaching.collect()} == want and 0 < len(want) < 800
    assert "Generate" not in reaching._jdf.queryExecution().optimizedPlan().toString()


def test_near_duplicates_of_a_template_and_its_edits(spark):
    # Edits of one template, and copies of the edits with a further change: pairs meet in large buckets, and classes are no stars.
    rng = random.Random(21)
    template = [f"t{i}" for i in range(240)]

    def edited(base, n):
        out = list(base)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"e{rng.randrange(10**9)}"
        return out

    edits = [edited(template, 9) for _ in range(150)]
    made = [(i, " ".join(t)) for i, t in enumerate(edits)] + [(1000 + i, " ".join(edited(edits[i], 3))) for i in range(50)]
    want = brute.near_classes(made, brute.idf_weights(made))
    assert 100 < len(set(want.values())) < 180 and all(want[1000 + i] == want[i] for i in range(40) if want[1000 + i] < 1000)
    table = spark.createDataFrame(made, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(table).collect()} == want


def test_the_pipeline_sends_texts_once_and_in_short_batches(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
        for name, stage in corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[2]:
            out = stage(spark, docs, DATA)
            sent = re.search(r"MapInArrow .*\n\W*(\w+)", out._jdf.queryExecution().optimizedPlan().toString())
            assert out.schema == docs.schema and sent[1].startswith("Relation"), name  # no column is added beside the text
            assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= corpus_pipeline.BATCH_ROWS
        cut = spark.range(0, 2000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert max(r["n"] for r in cut.collect()) <= 512
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
        corpus_pipeline.STAGES[0][1](spark, docs, DATA)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_idf_decides(spark):
    # Two pages with the site's boilerplate and own text of their own: alike by plain shingles, not by weighted ones.
    rng = random.Random(22)
    site = " ".join(f"b{i}" for i in range(300))
    own = lambda n: " ".join(f"o{rng.randrange(10**9)}" for _ in range(n))
    made = [(i, f"{site} {own(30)}") for i in range(2)] + [(10 + i, f"{site} {own(200)}") for i in range(120)] + [(1000 + i, own(60)) for i in range(80)]
    assert brute.near_classes(made, lambda s: 1.0)[1] == 0
    want = brute.near_classes(made, brute.idf_weights(made))
    assert want[1] == 1
    table = spark.createDataFrame(made, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(table).collect()} == want


def test_weights_depend_on_shares_not_on_size():
    rng = np.random.default_rng(23)
    common = near_dedup.BUCKETS // 4
    for n in (10_000, 100_000_000):
        # 400 rare shingles a document over all counters, and some counters with a shingle of a tenth of all documents.
        df = rng.poisson(400 * n / near_dedup.BUCKETS, near_dedup.BUCKETS)
        df[:common] += n // 10
        got = near_dedup.factors(df, n)
        assert abs(got[common:].mean() - 1.5) < 0.01 and abs(got[:common].mean() - (1 + 0.5 * np.log(10) / np.log(1024))) < 0.01


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for x in parent if sum(find(y) == find(x) for y in parent) > 1}


def test_multi_index(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    x[50:90] = x[50]
    made = [(i, v.tolist()) for i, v in enumerate(x)]
    made += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0] * 3), (None, [1.0] * 8), (1004, [1.0, None] * 4), (1005, [float("inf")] * 8)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in multi_index.search(table, table.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 600, 20):
        scores = x @ x[q]
        order = [int(i) for i in np.lexsort((np.arange(600), -np.round(scores, 9))) if i != q][:20]
        hits += len(set(order) & {i for i, _ in got[q]})
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True) and len(got[q]) == 20
    assert hits == 600 and set(got) == set(range(0, 600, 20))  # as many as LEAST are all ranked
    near = multi_index.search(table, table.filter("vec_id % 20 = 0"), least=1, share=0.3)
    assert near.count() == 600
    few = multi_index.search(table.filter("vec_id < 3"), table.filter("vec_id = 0"))
    assert few.count() == 2
    assert multi_index.search(table.filter("false"), table).collect() == []


def plain_nearest(made, asked, top=20):
    """[(query_id, rank, vec_id, score)] over usable (id, vector) rows."""
    out = []
    for q, v in asked:
        scored = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in made if i != q)[:top]
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    return sorted(out)


def test_multi_index_of_repeated_ids_and_large_vectors(spark):
    rng = np.random.default_rng(6)
    made = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    made += [(20, made[20][1])] * 29 + [(40, made[7][1]), (43, made[20][1]), (41, made[20][1])]  # one id thirty times, one id with two vectors
    made += [(100 + i, (np.array(made[3][1]) * 1e9).tolist()) for i in range(5)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = multi_index.search(table, table.filter("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, got)) == plain_nearest(made, [m for m in made if m[0] % 20 == 0])
    huge = [(i, (v * 10.0 ** rng.integers(150, 300)).tolist()) for i, v in enumerate(rng.normal(size=(40, 4)))]
    huge = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    got = multi_index.search(huge, huge.filter("vec_id % 20 = 0")).collect()
    assert collections.Counter(r["query_id"] for r in got) == {0: 20, 20: 20} and not any(np.isnan(r["score"]) for r in got)


def cones(seed, n=9000, width=24):
    """Vectors around 60 directions of unlike weights, of lengths between 0.5 and 2."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(60, width))
    x = centers[rng.choice(60, n, p=rng.dirichlet(np.ones(60)))] + rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0.5, 2, (n, 1))


def recall(spark, made, **limits):
    """Of the 20 nearest by brute force, the share that is found; and the share of vectors that a query compares."""
    ids, x = np.array(sorted(made)), np.array([made[i] for i in sorted(made)])
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in made.items()], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in multi_index.search(table, table.filter("vec_id % 200 = 0"), **limits).collect():
        got[r["query_id"]].add(r["vec_id"])
        assert r["score"] == pytest.approx(made[r["query_id"]] @ made[r["vec_id"]], rel=1e-9)
    asked = ids[ids % 200 == 0]
    found = sum(len(got[q] & set(ids[np.argsort(-np.where(ids == q, -np.inf, x @ made[q]), kind="stable")[:20]])) for q in asked)
    return found / (20 * len(asked))


def test_multi_index_recall_below_exhaustion(spark):
    made = dict(enumerate(cones(7)))
    assert multi_index.SHARE * len(made) > multi_index.LEAST and multi_index.SHARE <= 0.35
    assert recall(spark, made) >= 0.9


def test_multi_index_is_no_scan_beside_a_very_long_vector(spark):
    made = dict(enumerate(cones(8, 8000))) | {8000: np.eye(24)[3] * 1e6}
    book = multi_index.Codebook(np.array([made[i] for i in sorted(made)]), 128)
    cells = book.cells(np.array([made[i] for i in range(8000)]))
    assert len(np.unique(cells)) > 1500  # the long vector doesn't push all others into a few cells
    held = np.bincount(cells, minlength=len(book.centers[0]) * len(book.centers[1]))
    visited = [held[v].sum() for v in book.visits(np.array([made[i] for i in range(0, 8000, 200)]), held, 2800)]
    assert max(visited) < 0.5 * len(made)
    assert recall(spark, made, least=1) >= 0.9


def test_multi_index_of_vectors_of_one_component(spark):
    made = [(i, [float((-1) ** i * i)]) for i in range(30)] + [(40, [None])]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = multi_index.search(table, table.filter("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, got)) == plain_nearest(made[1:30], [(20, [20.0])])


def test_packed_blocks():
    held = np.array([3, 0, 4, 9, 1, 25, 2, 2])
    first, parts = multi_index.packed(held, 10)
    assert list(first) == [0, 0, 0, 1, 1, 2, 5, 5] and list(parts) == [1, 1, 1, 1, 1, 3, 1, 1]


def test_multi_index_keeps_ids_beside_a_repeated_one(spark):
    made = [(5, [1.0, 1.0])] * 30 + [(i, [1.0, 1.0]) for i in range(6, 16)] + [(i, [0.1, 0.001 * i]) for i in range(20, 60)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in multi_index.search(table, table.filter("vec_id = 6")).orderBy("rank").collect()]
    assert got == [5] * 20  # repeats are vectors of their own
    asked = table.filter("vec_id = 5").limit(1)
    got = [r["vec_id"] for r in multi_index.search(table, asked).orderBy("rank").collect()]
    assert got == [*range(6, 16), *range(59, 49, -1)]


def test_mixing(spark, docs, empty):
    rng = random.Random(6)
    made = [(i, " ".join(["w"] * rng.randint(0, 50)), f"s{rng.randrange(5) if rng.random() < 0.5 else 0}") for i in range(800)]
    made += [(900, None, "s1"), (901, "", None), (902, "one two", None), (903, "a\u00a0b c", "s9"), (7, made[7][1], made[7][2])]
    table = spark.createDataFrame([(*m, "x") for m in made], "doc_id long, text string, source string, size string")
    got = mixing.mix(table).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len(brute.BLANK.findall((t or "").encode()))) for i, t, _ in made)
    by, largest = collections.defaultdict(int), max(r["size"] for r in got)
    for r in got:
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        by[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(v - target) <= largest for (_, target), v in by.items())
    assert rows(mixing.mix(table.repartition(5))) == sorted(map(tuple, got), key=repr)
    total = sum(r["taken"] for r in got)
    out = mixing.apply(table)
    assert out.columns == table.columns and sum(len(brute.BLANK.findall((r["text"] or "").encode())) for r in out.collect()) == total
    assert mixing.mix(empty).collect() == []


def test_targets_and_flow():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 100, 100], [5, 2, 1])
    assert got[0] == 30 and abs(sum(got) - 210) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9
    supply = {("a",): 10, ("a", "b"): 10, ("b",): 5}
    assert mixing.route(supply, {"a": 20, "b": 5}) == ({("a",): 10, ("a", "b"): 10, ("b",): 5}, 25)  # no repeat is needed
    assert sum(mixing.route(supply, {"a": 40, "b": 5})[0].values()) == 45


def best_flow(supply, quotas, repeats):
    """The largest flow and its least cost, over all whole sizes that may be taken. Feasible if each set of patterns fits its sources' quotas."""
    patterns, best = list(supply), (0, 0)
    for taken in itertools.product(*(range(repeats * supply[p] + 1) for p in patterns)):
        subsets = (k for n in range(1, len(patterns) + 1) for k in itertools.combinations(range(len(patterns)), n))
        if all(sum(taken[i] for i in k) <= sum(quotas[s] for s in set().union(*(patterns[i] for i in k))) for k in subsets):
            cost = sum(mixing.pass_cost(u // supply[p] + 1) for p, t in zip(patterns, taken) for u in range(t))
            best = max(best, (sum(taken), -cost))
    return best[0], -best[1]


def test_flow_is_the_best_of_all():
    rng = random.Random(14)
    for _ in range(60):
        kinds = [("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c"), ("a", None)]
        supply = {p: rng.randint(1, 3) for p in rng.sample(kinds, rng.randint(1, 4))}
        quotas = {s: rng.randint(0, 9) for s in ("a", "b", "c", None)}
        taken, cost = mixing.route(supply, quotas, 2)
        assert (round(sum(taken.values()), 6), round(cost, 6)) == best_flow(supply, quotas, 2)
        assert all(t <= 2 * supply[p] + 1e-6 for p, t in taken.items())


def test_mixing_of_repeated_rows(spark):
    text = "one two three four five six seven eight"
    made = [(1, text, "a")] * 100 + [(i, text, "b") for i in range(2, 60)] + [(60, "x y", "c")]
    table = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(6)
    got = collections.defaultdict(int)
    for r in mixing.mix(table).collect():
        got[r["target"]] += r["taken"]
    assert len(got) == 3 and all(abs(taken - target) <= 4 for target, taken in got.items())
    assert rows(mixing.mix(table)) == rows(mixing.mix(table.repartition(3)))
    assert mixing.apply(table).filter("source = 'a'").count() * 8 == got[max(got)]


@pytest.mark.parametrize("small", [10_000, 10])
def test_mixing_of_many_and_of_overlapping_sources(spark, monkeypatch, small):
    monkeypatch.setattr(mixing, "SMALL", small)
    rng = random.Random(15)
    made = [(i, " ".join(["w"] * rng.randint(1, 9)), f"s{i % 5000:04}" if i % 7 else None) for i in range(9000)]
    table = spark.createDataFrame(made, "doc_id long, text string, source string")
    own = collections.Counter()
    for _, text, source in made:
        own[source] += len(text.split())
    names = sorted(own, key=lambda s: (s is None, s or ""))
    aims = dict(zip(names, mixing.targets([own[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))])))
    source_of, by = {i: s for i, _, s in made}, collections.Counter()
    for r in mixing.mix(table).collect():
        assert r["target"] == pytest.approx(aims[source_of[r["doc_id"]]]) and r["source_size"] == own[source_of[r["doc_id"]]]
        by[source_of[r["doc_id"]]] += r["taken"]
    assert len(own) > 4096 and all(abs(by[s] - aims[s]) <= 5 for s in names)
    made = [(i, "w " * rng.randint(1, 30), rng.choice([["a"], ["a", "b"], ["b", "c"], ["d"], ["d", "e", "d"], [], None, ["f", None]])) for i in range(600)]
    table = spark.createDataFrame(made, "doc_id long, text string, source array<string>")
    supply = collections.Counter()
    for _, text, sources in made:
        supply[tuple(sorted(set(sources or [None]), key=lambda s: (s is None, s or "")))] += len(text.split())
    names = sorted({s for p in supply for s in p}, key=lambda s: (s is None, s or ""))
    own = [sum(n for p, n in supply.items() if s in p) for s in names]
    quotas = dict(zip(names, mixing.targets(own, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], total=sum(supply.values()))))
    want, _ = mixing.route(supply, quotas)
    taken = sum(r["taken"] for r in mixing.mix(table, source_col="source").collect())
    assert abs(taken - sum(want.values())) <= 15 * len(supply)


def test_chat(spark):
    made = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (4, 0, "user", None), (5, 0, "user", ""), (6, 0, None, "hi"), (7, 0, "user", "hi"), (7, 1, "assistant", "yo"),
        (7, 2, "user", "more"), (8, None, "user", "x"), (8, None, "user", "x"), (None, 0, "user", "lost")
    ]
    table = spark.createDataFrame([(*m, "z") for m in made], "conv_id long, turn long, role string, text string, at string")
    got = {r["conv_id"]: r for r in chat.format_maximal(table).collect()}
    assert set(got) == {2, 4, 5, 6, 8} and got[2]["n_turns"] == 3 and got[8]["n_turns"] == 2
    assert got[2]["chat"].startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n")
    frame = table.toPandas()  # noqa: F841
    want = duckdb.sql(chat.oracle_sql("frame")).fetchall()
    assert sorted(want) == sorted((r["conv_id"], r["n_turns"], r["chat"]) for r in got.values())
    assert chat.format_maximal(table.filter("false")).collect() == []


def test_url_filter(spark):
    weights = url_filter.train(url_filter.labelled(spark))
    assert np.allclose(weights, url_filter.plain_weights())
    urls = [
        "https://A.Example.com/en/x", "http://www.example.com/en/", "https://x.net/fr/1", "https://notexample.com/en/",
        "http://spam-farm.example.org/en/9", "http://blog.thero.example.org/en/9?x=1", "https://x.net?q#f", "plain", None, "", "http://É.NET/es/",
        "x://com/"
    ]
    table = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(table, weights).collect()}
    assert [got[i]["rule"] for i in range(4)] == ["example.com/en/", "www.example.com/en/", "net/fr/", "com/"]
    assert [got[i]["verdict"] for i in range(6)] == ["block", "allow", "block", "allow", "block", "allow"]
    assert (got[6]["host"], got[6]["path"]) == ("x.net", "") and all((got[i]["host"], got[i]["path"]) == ("", "") for i in (7, 8, 9))
    frame = table.toPandas()  # noqa: F841
    columns = ("page_id", "host", "path", "rule", "verdict")
    assert sorted(duckdb.sql(url_filter.oracle_sql("frame")).fetchall(), key=repr) == sorted((tuple(r[c] for c in columns) for r in got.values()), key=repr)
    assert url_filter.train(url_filter.labelled(spark).filter("false")) == [0.0] * url_filter.BUCKETS
    assert url_filter.judge(table.filter("false"), weights).collect() == []


def test_registered_queries(spark):
    found = queries.queries()
    assert [n.split("_")[0] for n in found] == [f"op{i}" for i in range(1, 14)]
    texts = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert rows(found["op9_substring_dedup"](spark, DATA)) == sorted(brute.substring_dedup(texts), key=repr)
    assert rows(found["op4_run_length_index"](spark, DATA)) == sorted(brute.byte_repeats(texts), key=repr)
    assert rows(found["op8_decontaminate"](spark, DATA)) == sorted(brute.decontaminate(texts, items), key=repr)
    assert rows(found["op6_binary_records"](spark, DATA)) == sorted(brute.records(texts, queries.tokenizer_path()), key=repr)
    want = brute.near_classes(texts, brute.idf_weights(texts))
    assert {r["doc_id"]: r["class_id"] for r in found["op10_near_dedup"](spark, DATA).collect()} == want
    for name, sql in queries.oracle_sql().items():
        c = duckdb.connect()
        for t in ("pages", "conversations", "documents", "labels"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = c.sql(sql)
        assert rows(found[name](spark, DATA), *want.columns) == sorted(want.fetchall(), key=repr)


def test_ftrl_is_the_plain_rule():
    rng = np.random.default_rng(31)
    features = [np.unique(rng.integers(0, 40, 6)) for _ in range(300)]
    labels = np.array([float(3 in x or 5 in x) for x in features])
    got = toxicity.fit(features, labels, alpha=0.5, l1=1.5, epochs=3)
    n, z = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if i >= 0 and abs(z[i]) <= 1.5:
            return 0.0
        return -(z[i] - (np.sign(z[i]) * 1.5 if i >= 0 else 0)) / ((1 + n[i] ** 0.5) / 0.5 + 1)

    for _ in range(3):
        for x, y in zip(features, labels):
            at = [*map(int, x), -1]  # -1 is the bias
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert dict(zip(got.place.tolist(), got.weight)) == pytest.approx(want) and got.bias == pytest.approx(weight(-1))
    assert 0 < len(want) < 40


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    whole = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()}
    kept = stages["toxicity"](spark, docs, DATA)
    assert kept.columns == docs.columns and pairs(kept) == [(i, t) for i, t in pairs(docs) if whole[i]["score"] < 0.3]
    one = stages["near_dedup"](spark, kept, DATA)
    want = brute.near_classes(pairs(kept), brute.idf_weights(pairs(kept)))
    assert one.columns == docs.columns and pairs(one) == [(i, t) for i, t in pairs(kept) if want[i] == i]
    clean = stages["decontamination"](spark, one, DATA)
    hit = {r[0] for r in brute.decontaminate(pairs(one), [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]) if r[5]}
    assert clean.columns == docs.columns and pairs(clean) == [(i, t) for i, t in pairs(one) if i not in hit]
    mixed = corpus_pipeline.scratch.materialize(stages["mixing"](spark, clean, DATA), "mixed")
    taken, size, largest = collections.Counter(), collections.Counter(), 0
    for r in clean.collect():
        size[r["source"]] += len(brute.BLANK.findall(r["text"].encode()))
        largest = max(largest, len(brute.BLANK.findall(r["text"].encode())))
    for r in mixed.collect():
        taken[r["source"]] += len(brute.BLANK.findall(r["text"].encode()))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for name, aim in zip(names, mixing.targets([size[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))])):
        assert abs(taken[name] - aim) <= largest / 2 + 1
    got = [tuple(r) for r in stages["token_records"](spark, mixed, DATA).select("doc_id", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == sorted((i, n, c) for i, _, n, c in brute.records(pairs(mixed), queries.tokenizer_path()))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    odd = spark.read.parquet(f"{DATA}/documents.parquet").limit(30).withColumns({"key": F.lit("k"), "size": F.lit(1)})
    nothing = [(None, None), (None, "kata loso"), (None, "kata loso"), (1, ""), (1, "")]
    odd = odd.unionByName(spark.createDataFrame(nothing, "doc_id long, text string"), allowMissingColumns=True)
    for name, table in (("odd", odd), ("empty", odd.filter("false"))):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{DATA}/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert bool(got) == (name == "odd")
        if got:  # reruns agree
            again = corpus_pipeline.run(spark, folder).collect()
            assert sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in again) == sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in got)
        assert len([r for r in got if r["doc_id"] is None]) <= 3 and all(r["n_tokens"] > 1 for r in got)


def thue_morse(n, zero="a", one="b"):
    """Two strings of 2**n letters whose polynomial hashes agree modulo 2**64 for every odd base, if n is 10 or more."""
    x, y = zero, one
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_hashes_are_sound():
    x, y = (np.frombuffer(t.encode(), np.uint8) for t in thue_morse(10))
    everything = np.array([0]), np.array([len(x)])
    assert bytescan.of_bytes(x).of(*everything) == bytescan.of_bytes(y).of(*everything)  # why these only pick anchors
    assert bytescan.PrimeRolling(x.astype(np.uint64)).of(*everything) != bytescan.PrimeRolling(y.astype(np.uint64)).of(*everything)
    assert bytescan.slice_hashes(x, *everything) != bytescan.slice_hashes(y, *everything)
    values = np.random.default_rng(1).integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    rolling = bytescan.PrimeRolling(values)
    for s, e in ((0, 5), (7, 290), (299, 300)):
        assert int(rolling.of(np.array([s]), np.array([e]))[0]) == sum(int(values[i]) * pow(bytescan._PRIME_BASE, i - s, bytescan.PRIME) for i in range(s, e)) % bytescan.PRIME


def test_no_clash_of_thue_morse_texts(spark, tmp_path):
    x, y = thue_morse(10)
    p, q = (t.replace("", " ").strip() for t in thue_morse(10, "k", "w"))
    rng = random.Random(3)
    head, tail = words(rng, 40), words(rng, 40)
    made = [(1, f"{head} {x} {tail}"), (2, f"{head} {y} {tail}"), (3, p), (4, q), (5, x), (6, y), (7, x + y), (8, y + x)]
    table = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(substring_dedup.dedup(table)) == sorted(brute.substring_dedup(made), key=repr)
    assert rows(run_length_index.dedup(table)) == sorted(brute.byte_repeats(made), key=repr)
    got = records.encode(table, queries.tokenizer_path(), f"file://{tmp_path}/r")
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute.records(made, queries.tokenizer_path()), key=repr)


def test_records_of_one_hot_id_fill_several_shards(spark, tmp_path):
    rng = random.Random(12)
    made = [(i, words(rng, 30)) for i in range(60)] + [(70, "one text again and again " * 5)] * 200 + [(None, words(rng, 20)) for _ in range(100)] + [(80, words(rng, 20_000))]
    table = spark.createDataFrame(made, "doc_id long, text string").repartition(7)
    got = records.encode(table, queries.tokenizer_path(), f"file://{tmp_path}/r", shard_bytes=8000)
    have = sorted(map(tuple, got.select("start", "doc_id", "n_tokens", "ids_crc32", "shard").collect()))
    assert collections.Counter((i, n, c) for _, i, n, c, _ in have) == collections.Counter((i, n, c) for i, _, n, c in brute.records(made, queries.tokenizer_path()))
    assert [i is None for _, i, *_ in have] == sorted(i is None for _, i, *_ in have)
    assert [r[1] for r in have if r[1] is not None] == sorted(i for i, _ in made if i is not None)
    assert [r[0] for r in have] == list(np.cumsum([0] + [r[2] for r in have[:-1]]))
    assert len({r[4] for r in have if r[1] == 70}) > 2 and len({r[4] for r in have if r[1] is None}) > 1
