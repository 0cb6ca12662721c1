"""Structure repair, digest index and filter audit against plain versions, on fixtures with nulls, ties, repeats and odd columns."""

import collections
import hashlib
import itertools
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import digest_index, filter_audit, queries, structure_repair

DATA = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
BLANKS = " \t\n\x0b\x0c\r"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()), key=repr)


def damaged(table):
    out = []
    for conv, turn, role, text in table:
        said = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2], said[3]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.rstrip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def outcomes(turns, found, every=False):
    """(cost, audit, repaired turns) of the best, or of all ways with up to 2 inserts in a row."""
    after = lambda initials: "u" if initials in ("", "s") or initials[-1] == "a" else "a"
    full = {"u": "user", "a": "assistant"}

    def inserts(way, k):
        cost, audit, made = way
        for _ in range(k):
            made = (*made, (full[after("".join(r[:1] or "-" for r, _ in made))], ""))
        return cost + 2 * k, audit + "I" * k, made

    ways = [(0, "", ())]
    for (_, role, text), fault in zip(turns, found):
        nexts = []
        for way, k in itertools.product(ways, range(3)):
            cost, audit, made = inserts(way, k)
            nexts.append((cost + 3, audit + "D", made))
            if fault not in ("blank", "duplicate"):
                cost += fault == "truncated"
                initials = "".join(r[:1] or "-" for r, _ in made)
                nexts.append((cost + 2, audit + "R", (*made, (full[after(initials)], text))))
                if re.match(r"s?(ua)*u?\Z", initials + (role[:1] or "-")):
                    nexts.append((cost, audit + "K", (*made, (role, text))))
        if not every:  # the best of each state, by whole strings
            best = {}
            for way in sorted(nexts, key=lambda w: w[:2]):
                initials = "".join(r[:1] for r, _ in way[2])
                best.setdefault("" if not initials else "s" if initials == "s" else initials[-1], way)
            nexts = list(best.values())
        ways = nexts
    ends = [inserts(way, k) for way, k in itertools.product(ways, range(3))]
    return min((w for w in ends if LEGAL.match("".join(r[:1] or "-" for r, _ in w[2]))), key=lambda w: w[:2])


def plain_repair(table, ids, every=False):
    convs = {i: [] for i in ids}
    for conv, turn, role, text in table:
        convs[conv].append((turn, role, text))
    out = []
    for conv, turns in convs.items():
        numbers = {t for t, *_ in turns if t is not None}
        hashes = lambda t: hashed[t]
        hashed = {t: i for i, t in enumerate(sorted({t for *_, t in turns}))}
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashes(r[2])))
        found = faults(turns)
        count = collections.Counter(found)
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, made = outcomes(turns, found, every)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def some_turns(seed, convs, longest):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", ""], ["Yes.", "no", " \t\x0b", "", "Well! \n", "so?", "one", "two.", "três.\r\n", "a\x00b"]
    return [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(convs) for t in rng.sample(range(40), rng.randint(1, longest))]


def test_repair_is_the_cheapest_of_all(spark):
    table = some_turns(5, 150, 4)
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(4)
    assert rows(structure_repair.repair(frame), *COLUMNS) == plain_repair(table, {r[0] for r in table}, every=True)


def test_repair_of_odd_tables(spark):
    long_talk = [(7000, t, "user" if t % 2 else "assistant", f"{t} said.") for t in range(3000)]
    regular = [(c, t, ("user", "assistant")[t % 2], f"{c} {t} all right.") for c in range(8000, 8120) for t in range(8)]
    odd = [(None, 1, "user", "x."), (None, None, None, None), (None, 1, "assistant", "y."), (9000, None, "user", None), (9001, 3, "system", "ok."), (9002, 5, "user", "z" * 200_000)]
    table = some_turns(6, 200, 30) + long_talk + regular + odd
    same_turn = [(9100, 4, "user", "same."), (9100, 4, "user", "same."), (9100, 5, "assistant", "same.")]
    table += same_turn
    frame = spark.createDataFrame([(*r, "k", 1) for r in table], "conv_id long, turn long, role string, text string, conv string, symbol int").repartition(5)
    hurt = structure_repair.damage(frame)
    assert rows(hurt, "conv_id", "turn", "role", "text") == sorted(damaged(table), key=repr)
    got = rows(structure_repair.repair(hurt, frame), *COLUMNS)
    assert got == plain_repair(damaged(table), {r[0] for r in table})
    gone = [r for r in got if r[7] == ""]
    assert gone and all(r[1:7] == (0,) * 6 and r[8] == hashlib.sha256().hexdigest() for r in gone)
    assert structure_repair.repair(frame.filter("false"), frame.filter("false")).collect() == []
    assert dict(frame.dtypes)["conv_id"] == dict(structure_repair.repair(hurt).dtypes)["conv_id"]


def test_repair_meets_few_layers():
    layers, rng = structure_repair.Layers(), random.Random(1)
    for _ in range(300):
        layers.solve(bytearray(4 * rng.randrange(4) + rng.randrange(4) for _ in range(60)))
    assert len(layers.known) < 400
    assert layers.solve(bytearray()) == (0, "")


def test_repair_has_one_exchange_for_turns_and_one_for_texts(spark):
    frame = spark.createDataFrame(some_turns(5, 5, 4), "conv_id long, turn long, role string, text string")
    plan = structure_repair.repair(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def plain_dedup(docs):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    groups = collections.defaultdict(list)
    for i, text in docs:
        groups[(text or "").translate(lower)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def copies():
    rng = random.Random(8)
    docs = [(i, f"Text {rng.randrange(40)} of SOME length") for i in range(200)] + [(i, "the hot ONE" if i % 2 else "The Hot one") for i in range(1000, 1300)]
    docs += [(None, None), (None, ""), (5, ""), (6, None), (None, "only null ids"), (None, "Only null ids"), (7, "É"), (8, "é"), (9, "x" * 300_000), (10, "X" * 300_000), (1299, "the hot one")]
    return docs


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_digest_index(spark, batches):
    frame = spark.createDataFrame([(*r, "k", 2) for r in copies()], "doc_id long, text string, digest string, batch int").repartition(3)
    assert rows(digest_index.dedup(frame, batches=batches)) == plain_dedup(copies())
    assert digest_index.dedup(frame.filter("false"), batches=batches).collect() == []


def test_digest_index_persists(spark, tmp_path):
    frame = spark.createDataFrame(copies(), "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    index = digest_index.DigestIndex(spark, path, 4)
    first = digest_index.materialize(digest_index.digests(frame.filter("doc_id < 1000")), "first")
    index.ingest(first, 0)
    held = rows(index.entries())
    index.close()
    again = digest_index.DigestIndex(spark, path)  # as a later session does
    assert again.buckets == 4 and rows(again.entries()) == held
    second = digest_index.materialize(digest_index.digests(frame), "second")
    again.ingest(second, 1)
    once = rows(again.entries())
    again.ingest(second, 1)  # a batch that is taken in again changes nothing
    assert rows(again.entries()) == once
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    assert len(once) == len({(t or "").translate(lower) for _, t in copies()})
    assert {r[0]: r[1] for r in once}.items() >= {r[0]: r[1] for r in held}.items()  # what is in the index stays
    judged = again.judge(second.withColumn("batch", F.lit(1)))
    assert judged.count() == len(copies()) and judged.filter("kept and keep_id < 1000 and keep_id > 10").count() == 0
    again.close()


def test_digest_index_is_not_shuffled(spark, tmp_path):
    index = digest_index.DigestIndex(spark, f"file://{tmp_path}/index", 4)  # as many as the session has shuffle partitions
    table = spark.createDataFrame(copies(), "doc_id long, text string")
    index.ingest(digest_index.digests(table), 0)
    fresh = index.new_entries(digest_index.digests(table), 1)
    fresh.collect()
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    index.close()


def plain_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    firsts = {}
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    parts = collections.defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        w = words(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and firsts[t] < i]
        of = [(q, x) for j, q, x in labels if j == i and i is not None]
        parts[source or ""].append((fails, any(q == 1 for q, _ in of), any(x == 1 for _, x in of)))
    out = []
    for part, held in parts.items():
        shapley, lines = collections.Counter(), []
        for order in itertools.permutations(range(5)):
            left = held
            gone = []
            for step, f in enumerate(order):
                lost = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                shapley[f] += len(lost)
                name = "".join("ABCDE"[g] for g in order)
                only = sum(d[0][f] and sum(d[0]) == 1 for d in held)
                lines.append(((part, name, step + 1, len(left), len(lost), sum(d[0][f] for d in gone), only, sum(d[1] for d in lost), sum(d[2] for d in lost)), f))
                gone = gone + lost
        out += [(*line, shapley[f]) for line, f in lines]
    return sorted(out, key=repr)


def test_filter_audit(spark):
    rng = random.Random(9)
    long_text = lambda n, kinds: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    texts = [long_text(250, 400), long_text(250, 20), long_text(220, 300).upper(), "a # b", "", None, "é" * 40 + "AA", long_text(300, 500) + " 5 %", " \x0b ", long_text(30_000, 50_000)]
    texts += [long_text(rng.choice([100, 210]), rng.choice([60, 400])) for _ in range(20)]
    docs = [(i, rng.choice(texts), rng.choice(["one", "two", "two", None, ""])) for i in range(160)]
    docs += [(None, texts[0], "two"), (None, texts[0], "two"), (None, "a # b", "only null ids"), (3, texts[0], "one"), (3, texts[0], "one"), (500, texts[1], "three")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(100)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, source string, mask int, part string").repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.interactions(filter_audit.cells(frame, said))
    assert rows(got) == plain_audit(docs, labels)
    assert filter_audit.interactions(filter_audit.cells(frame.filter("false"), said)).collect() == []
    assert {r["good_lost"] for r in filter_audit.interactions(filter_audit.cells(frame, said.filter("false"))).collect()} == {0}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_plain_changes_visit_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for j in filter_audit.plain_changes(n):
        order[j], order[j + 1] = order[j + 1], order[j]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == len(list(itertools.permutations(range(n))))


def test_walk_of_many_parts_at_once():
    counts = np.random.default_rng(2).integers(0, 9, (70, 8, 3))
    visits, shapley = filter_audit.walk(counts, 3)
    assert len(visits) == 6
    for f in range(3):
        assert (shapley[f] == sum(steps[order.index(f)][1] for order, steps in visits)).all()


def test_registered_queries(spark):
    found = queries.queries()
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{DATA}/{t}.parquet").collect()]
    talks = read("conversations")
    assert rows(found["op11_structure_repair"](spark, DATA), *COLUMNS) == plain_repair(damaged(talks), {r[0] for r in talks})
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert rows(found["op12_digest_index"](spark, DATA)) == plain_dedup([d[:2] for d in docs])
    assert rows(found["op13_filter_audit"](spark, DATA)) == plain_audit(docs, read("labels"))
