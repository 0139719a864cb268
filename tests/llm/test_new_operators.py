"""Repair, repeats and manifest against brute force; rows and columns that must not get lost."""

from __future__ import annotations

import hashlib
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontamination, dedup, merkle, repair, repeats, secrets, walks

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def brute_repair(rows):
    """Cheapest (cost, audit, turns) by a plain forward program over all rows."""
    seen, states = set(), {"": (0, "", ())}
    follow = {"": ("user", "U"), "S": ("user", "U"), "U": ("assistant", "A"), "A": ("user", "U")}

    def inserts(states):
        for _ in range(3):
            for q, (c, a, t) in list(states.items()):
                role, to = follow[q]
                new = (c + 3, a + "I", (*t, (role, "")))
                if to not in states or new < states[to]:
                    states[to] = new
        return states

    for role, text in rows:
        must = not text.strip(repair.BLANKS) or (role, text) in seen
        seen.add((role, text))
        extra = 0 if text.rstrip(repair.BLANKS)[-1:] in tuple(".!?") else 3
        after = {}

        def offer(q, value):
            if q not in after or value < after[q]:
                after[q] = value

        for q, (c, a, t) in inserts(states).items():
            offer(q, (c + 4, a + "D", t))
            if not must:
                name, to = follow[q]
                offer(to, (c + 3 + extra, a + "R", (*t, (name, text))))
                if role[:1] == name[0]:
                    offer(to, (c + extra, a + "K", (*t, (role, text))))
                if role[:1] == "s" and q == "":
                    offer("S", (c + extra, a + "K", (*t, (role, text))))
        states = after
    return min(v for q, v in inserts(states).items() if q in ("", "A"))


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_repair_against_brute_force(spark, block_rows, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block_rows)
    rng = random.Random(3)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["a.", "b!", "cut", " ", "", None, "c?\n", "d"]
    rows = []
    for conv in range(60):
        for _ in range(rng.randint(1, 14)):
            rows.append((conv if conv else None, rng.choice([None, *range(8)]), rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts)))
    rows += [(99, t, "user", "same") for t in range(50)] + [(99, 3, "user", "same")] * 40  # one long run
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("conv", F.lit(1)).withColumn("rows", F.lit(2)).repartition(5)
    got = {r["conv_id"]: r for r in repair.op_columns(df, repair.repair(df)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    assert set(got) == set(by)
    for conv, members in by.items():
        members.sort()
        cost, audit, turns = brute_repair([m[2:] for m in members])
        r = got[conv]
        assert (r["cost"], r["audit"]) == (cost, audit)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
        known = sorted({m[1] for m in members if m[0]})
        assert r["gaps"] == (known[-1] - known[0] + 1 - len(known) if known else 0)
        assert r["illegal"] == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(members, members[1:], strict=False))


def test_repair_of_nothing(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.")], CONVERSATIONS)
    left = repair.op_columns(rows, repair.repair(rows.limit(0))).collect()
    assert [(r["cost"], r["audit"], r["repaired_sha256"]) for r in left] == [(0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.op_columns(rows.limit(0), repair.repair(rows.limit(0))).count() == 0


def test_runs_are_powers():
    for symbol in range(9):
        one = repair.transition(symbol)
        plain = repair.IDENTITY
        for n in range(1, 20):
            plain = repair.multiply(plain, one)
            assert repair.across([(symbol, n)]) == plain
    choices = repair.Choices()
    for symbol, state, length in product(range(9), range(4), (1, 2, 5, 13)):
        behind, letters, at = repair.END, "", state
        costs = [behind]
        for _ in range(length):
            costs.append(repair.apply(repair.transition(symbol), costs[-1]))
        for cost in reversed(costs[:-1]):
            piece, at = repair.row_choice(symbol, at, cost)
            letters += piece
        assert choices.of_block([(symbol, length)], state, behind) == ([letters], at)


def brute_repeats(docs, length):
    first = {}
    for doc, text in docs:
        if doc is not None:
            for p in range(len(text) - length + 1):
                g = text[p : p + length]
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in docs:
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1) if doc is not None else ():
            if first[text[p : p + length]] < doc:
                gone[p : p + length] = b"\1" * length
        out.append((doc, bytes(b for b, g in zip(text, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("slice_bytes", "turn", "batch"), [(8 << 20, 1 << 18, 1 << 16), (900, 100, 50)])
def test_repeats_against_brute_force(spark, slice_bytes, turn, batch, monkeypatch):
    for name, value in (("SLICE_BYTES", slice_bytes), ("TURN", turn), ("BATCH", batch), ("RANGE_BYTES", 2000), ("CHUNK", 128)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé\0") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(6)]
    rows = []
    for doc in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 20)
            parts.insert(rng.randint(0, 3), p[cut:] if rng.random() < 0.5 else p)
        rows.append((doc * 7 % 120, "".join(parts)))
    rows += [(500, "a" * 300), (501, "a" * 120), (502, "ab" * 100), (3, "ab" * 90), (None, passages[0]), (None, None), (600, None), (601, ""), (602, rows[5][1]), (602, rows[5][1]), (602, passages[1] * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1)).repartition(4)
    got = sorted(((r["doc_id"], bytes(r["kept"])) for r in repeats.remove_repeats(df).collect()), key=str)
    assert got == sorted(brute_repeats([(d, (t or "").encode()) for d, t in rows], 50), key=str)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_family_levels_grow_geometrically():
    family, rng = repeats.Family(), np.random.default_rng(1)
    everything = {}
    for i in range(13):
        strings = np.array([b"%03d" % v for v in rng.integers(0, 400, 50)], "S3")
        ids = rng.integers(0, 1000, 50)
        for s, d in zip(strings.tolist(), ids.tolist(), strict=True):
            everything[s] = min(d, everything.get(s, d))
        strings, ids, _ = family.array(strings, ids)
        family.add(strings, ids)
    assert [rank for rank, _, _ in family.levels] == [3, 2, 0]
    asked = np.array(sorted(everything), "S3")
    assert family.least(asked).tolist() == [everything[s] for s in asked.tolist()]


def brute_tree(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([hashlib.sha256("".join(last[i : i + fanout]).encode()).hexdigest() for i in range(0, len(last), fanout)])
    return levels


@pytest.mark.parametrize("shape", [merkle.Shape(), merkle.Shape(2, 2), merkle.Shape(3, 1)])
def test_manifest_against_brute_force(spark, shape):
    rows = [(i, "x" if i % 5 else ("y" if i % 10 else None), f"t{i % 37}") for i in range(90)] + [(None, "x", "n"), (3, "x", "t3"), (3, "x", None), (1, "z", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumn("rank", F.lit(0)).repartition(4)
    leaf = merkle.digest(merkle.field(F.col("doc_id")), merkle.field(F.col("text")))
    found = merkle.manifest(df, "lang", ["doc_id"], leaf, F.struct("doc_id"), shape).collect()
    plain = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for d, g, t in rows:
        groups.setdefault(g, []).append((d is not None, d or 0, hashlib.sha256((plain(d) + plain(t)).encode()).hexdigest()))
    trees = {g: brute_tree([m[2] for m in sorted(members)], shape.fanout) for g, members in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, g or ""))
    root = brute_tree([trees[g][-1][0] for g in order], shape.fanout)[-1][0]
    assert len(found) == len(rows)
    for r in found:
        assert r["leaf"] == trees[r["group"]][0][r["rank"]] and r["subroot"] == trees[r["group"]][-1][0] and r["root"] == root
        own = r["leaf"]
        for step in r["path"]:
            own = hashlib.sha256((step["left"] + own + step["right"]).encode()).hexdigest()
        assert own == root
    some = spark.createDataFrame([("x", 3), ("x", 40), (None, 0)], "group string, rank bigint")
    asked = merkle.manifest(df, "lang", ["doc_id"], leaf, F.struct("doc_id"), shape, requests=some).collect()
    assert sorted(map(str, asked)) == sorted(str(r) for r in found if (r["group"], r["rank"]) in (("x", 3), ("x", 40), (None, 0)))
    assert merkle.manifest(df.limit(0), "lang", ["doc_id"], leaf, F.struct("doc_id"), shape).count() == 0


@pytest.mark.parametrize("n", [5, 20, 50, 100, 200])
def test_walks_find_the_most_edits(n):
    """The walks alone, without gate: fresh pairs at exactly the most edits."""
    rng, k = np.random.default_rng(n), decontamination.allowed(n, 0.2)
    effort = walks.effort(n, k, 0.998)
    hits, trials = 0, 400
    for _ in range(trials):
        item = rng.integers(1, 1 << 28, n)
        copy = walks.edited(rng, item, k)
        one = walks.keys(item, np.array([0]), np.array([n]), effort, 0)
        two = walks.keys(copy, np.array([0]), np.array([min(n, len(copy))]), effort, 1)
        hits += bool((one == two).any())
    assert hits >= 0.99 * trials


def test_walks_lose_none_of_the_passages_that_a_full_search_finds(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 15, 40, 120])))) for i in range(40)]
    texts = []
    for i in range(200):
        words = items[i % 40][1].split()
        for _ in range(rng.randint(0, int(0.2 * len(words)))):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["other"], [words[at], "more"]])
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(30)] + words + [rng.choice(vocabulary) for _ in range(30)]))
    near = decontamination.Matcher(items, decontamination.Settings()).matches(texts)
    whole = decontamination.Matcher(items, decontamination.Settings(exhaustive=True)).matches(texts)
    places = lambda found: {(i, m) for i, ms in enumerate(found) for m in ms}
    assert len(places(whole)) >= 180 and len(places(near) & places(whole)) >= 0.99 * len(places(whole)) and places(near) <= places(whole)


CLASHING = ["_id", "_text", "_mask", "_doc", "matches", "row", "key", "made", "id", "owner", "repo", "masked", "sketch", "bands"]


def test_stages_keep_rows_and_columns_of_any_name(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long, "s"), (1, "totally different text that is clean here", "s"), (2, long + " end", None), (None, long, "s"), (None, "alone without an id", "t"), (3, None, "s"), (4, "", "s"), (4, "", "s"),
            (5, "password = 'abcdef123'", "s"), (6, "quite another text with words of its own", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for c in CLASHING:
        df = df.withColumn(c, F.lit(c))
    kept = dedup.keep_one(df)
    assert kept.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(left, key=str).count((4, "")) == 1 and (1, "totally different text that is clean here") in left and (None, "alone without an id") in left and (3, None) in left
    assert len([t for _, t in left if t and t.startswith("word0")]) == 1 and len(left) == 7
    named = df.withColumn("doc_id", F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    assert dedup.keep_one(named).count() == 7
    benchmark = spark.createDataFrame([(1, long)], "item_id bigint, text string")
    clean = decontamination.drop_leaks(df, benchmark)
    assert clean.columns == df.columns and clean.count() == 7 and {r["matches"] for r in clean.collect()} == {"matches"}
    masked = secrets.mask_live(df, F.col("source"), secrets.name(F.col("source")))
    assert masked.columns == df.columns and masked.count() == len(rows) and masked.filter("text like '%[secret]%'").count() == 1
    empty = df.limit(0)
    assert dedup.keep_one(empty).count() == decontamination.drop_leaks(empty, benchmark).count() == secrets.mask_live(empty, F.col("source"), F.col("source")).count() == 0


def test_null_owners_are_owners(spark):
    value = "token = q8Zr1LmX92vT"
    df = spark.createDataFrame([(1, value, None), (2, value, ""), (3, value, "b")], "doc_id bigint, text string, owner string")
    found = secrets.scan_secrets(df, F.col("owner"), F.col("owner")).collect()
    assert all(s["n_owners"] == 3 and s["copied"] for r in found for s in r["spans"])
