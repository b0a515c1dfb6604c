"""Clustering with ball trees, disguised personal data and the filter audit against brute force, and edge cases."""

import hashlib
import math
import re
from itertools import permutations

import numpy as np
import pytest

from icewake.llm import ball_trees, disguised_pii, filter_audit, queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, cluster string"


# ---- clusters


def clusters_by_brute_force(rows, k, rounds, salt="2:"):
    kept = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows]
    start = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None)[:k]
    centroids, x = np.array([v for _, v in start]), np.array([v for _, v in kept])
    square = lambda: ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        to = square().argmin(axis=1)
        for z in range(len(centroids)):
            if (to == z).any():
                centroids[z] = [int(s) // int((to == z).sum()) for s in x[to == z].sum(axis=0)]
    d = square()
    to, best = d.argmin(axis=1), d.min(axis=1)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return sorted(((i, int(z), int(b), int(best[to == z].sum()), int(best.sum()), digest[z]) for (i, _), z, b in zip(kept, to, best, strict=True)), key=str)


def test_op11_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_ball_tree_clusters(spark, SF).collect()), key=str)
    assert got == clusters_by_brute_force(rows, 40, 5)


def test_op11_copies_ties_and_rows_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(ball_trees, "BLOCK", 64)
    rng = np.random.default_rng(5)
    # eight far clusters (whole balls), one vector very many times, lattice points with ties, negative components
    vectors = [(rng.normal(size=4) * 0.01 + 3 * (k % 8) - 9).tolist() for k in range(300)] + [[1.0, 1.0, 1.0, 1.0]] * 200
    vectors += [[float(a), float(b), 0.5, -0.5] for a in range(-3, 4) for b in range(-3, 4)]
    rows = [(k, np.float32(v).tolist()) for k, v in enumerate(vectors)] + [(7, np.float32(vectors[9]).tolist())] + [(None, [0.25] * 4)]
    odd = [(9001, None), (9002, [1.0] * 3), (9003, [1.0, None, 1.0, 1.0]), (9004, [float("nan")] * 4), (9005, [float("inf"), 0.0, 0.0, 0.0]), (9006, [])]
    frame = spark.createDataFrame([(i, v, 0, "c") for i, v in rows + odd], VECTORS)
    for k, rounds in ((6, 4), (12, 0), (40, 3)):
        got = sorted((tuple(r) for r in ball_trees.cluster(frame, k, rounds, size=4).collect()), key=str)
        assert got == clusters_by_brute_force(rows, k, rounds)


def test_op11_few_none_and_too_large(spark):
    few = spark.createDataFrame([(1, [0.5, 1.0], 0, "c"), (2, [0.5, 1.0], 0, "c"), (3, [4.0, 1.0], 0, "c")], VECTORS)
    assert sorted(tuple(r)[:3] for r in ball_trees.cluster(few, size=2).collect()) == sorted(r[:3] for r in clusters_by_brute_force([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [4.0, 1.0])], 40, 5))
    none = ball_trees.cluster(few.filter("false"), size=2)
    assert none.count() == 0 and none.columns == ball_trees.cluster(few, size=2).columns
    large = spark.createDataFrame([(1, [1e30, 0.0], 0, "c")], VECTORS)
    with pytest.raises(Exception, match="exact distances"):
        ball_trees.cluster(large, size=2)
    with pytest.raises(ValueError):
        ball_trees.cluster(few, k=0, size=2)


def test_op11_balls_are_given_whole():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-5, 5, (500, 8)) + c for c in (0, 4000, -4000, 9000)]).astype(np.int64)
    order, tree = ball_trees.BallTree.build(points)
    assert sorted(order) == list(range(2000)) and (tree.points == points[order]).all()
    centroids = np.array([[0] * 8, [4000] * 8, [-4000] * 8, [9000] * 8])
    whole, to, rows, best, square = tree.filtered(centroids)
    assert tree.counts[whole].sum() + len(rows) == 2000 and tree.counts[whole].sum() > 1800 and len(whole) < 40
    want = ((points[order][:, None] - centroids[None]) ** 2).sum(axis=2)
    for node, z in zip(whole, to, strict=True):
        assert (want[tree.starts[node] : tree.ends[node]].argmin(axis=1) == z).all()
    assert (want[rows].argmin(axis=1) == best).all() and (want[rows].min(axis=1) == square).all()
    wide = np.array([[1 << 26] * 64, [-(1 << 26)] * 64])
    assert ball_trees.squared_distances(wide, wide).tolist() == [[0, 64 << 54], [64 << 54, 0]]


# ---- personal data


def plain_matches(text):
    """The stated patterns as they are, searched plainly."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], disguised_pii.KINDS.index(x[0])))


def joined(found):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def test_op12_base_equals_plain_patterns(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = 0
    for r in queries.op12_disguised_pii(spark, SF).collect():
        want = plain_matches(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in disguised_pii.KINDS] == [sum(x[0] == k for x in want) for k in disguised_pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(filter(None, joined(want).split(","))) <= set(r["spans"].split(","))
        seen += len(want)
    assert seen > 20


def test_op12_random_texts_equal_plain_patterns():
    rng = np.random.default_rng(3)
    for letters in ("a1.@-+ ", "12.", "+1 ().-", "ab@.%_-é1", "4 1-"):
        for _ in range(400):
            text = "".join(rng.choice(list(letters), rng.integers(0, 60)))
            got = [(disguised_pii.KINDS[k], s, e) for s, k, e, base in disguised_pii.spans(text) if base]
            assert got == plain_matches(text), text


DISGUISED = [
    ("email", "bob [at] example [dot] com"), ("email", "bob at example dot com"), ("email", "b.ob(at)mail(dot)example(dot)org"), ("email", "Bob AT example DOT co DOT uk"),
    ("email", "jоhn.doe@example.com"), ("email", "b​ob@exam​ple.com"), ("email", "ｂｏｂ＠example.com"), ("email", "bоb [аt] example dоt com"), ("email", "bob at example punkt de"),
    ("card", "４１１１ １１１１ １１１１ １１１１"), ("card", "four one one one one one one one one one one one one one one one"), ("card", "4111-1111-1111-one one one one"), ("card", "cuatro uno uno uno 1111 1111 1111"),
    ("phone", "plus four four two zero seven nine four six zero nine five eight"), ("phone", "plus 49 30 1234567"), ("phone", "＋44 20 7946 0958"),
    ("ip", "one nine two dot one six eight dot one dot one"), ("ip", "192[.]168[.]1[.]1"), ("ip", "10 dot 0 dot 0 dot 1"), ("ip", "١٩٢.١٦٨.١.١"),
]


@pytest.mark.parametrize("before", ["", "see: ", "ÀÉ ß 😀 ", "zero​. "])
def test_op12_disguises_are_found_where_they_stand(before):
    for kind, written in DISGUISED:
        text = f"{before}{written}, and more"
        found = [(disguised_pii.KINDS[k], text[s:e]) for s, k, e, _ in disguised_pii.spans(text)]
        assert (kind, written) in found, text
        assert [x for x in disguised_pii.spans(text) if x[3]] == [(s, disguised_pii.KINDS.index(k), e, True) for k, s, e in plain_matches(text)]


@pytest.mark.parametrize("text", ["look at the red dot on the wall", "meet at noon. point taken", "one, two or three of four", "at first dot com was new", "zero point five", "Он пришёл домой в пять часов.", "plus one for that", "eins zwei drei vier", "he is at home"])
def test_op12_clean_texts_have_no_spans(text):
    assert disguised_pii.spans(text) == []


def test_op12_places_lead_back_to_the_source():
    """Every written character against a plain walk over the rewritings, on random mixtures."""
    t = disguised_pii.Transducer()
    rng = np.random.default_rng(8)
    parts = ["one", "oh", " ", "-", ", ", "at", "dot", "а", "t", "​", "x", "7", "[", "]", "@", ".", "com", "４", "plus", "Ö", "İ", "\n"]
    for _ in range(600):
        text = "".join(rng.choice(parts, rng.integers(0, 40)))
        new, noted = t.rewritten(text)
        assert [x[2] for x in noted] == sorted(x[2] for x in noted) and [x[0] for x in noted] == sorted(x[0] for x in noted)
        source, read, at = [], 0, 0
        for a, b, s, e in noted:
            source += [(k, k + 1) for k in range(read, s)] + [(s, e)] * (b - a)
            read = e
        source += [(k, k + 1) for k in range(read, len(text))]
        assert len(source) == len(new)
        places = disguised_pii.Places(noted)
        for at in range(len(new) if noted else 0):
            assert (places.start(at), places.end(at + 1)) == source[at]


def test_op12_edge_cases(spark):
    rows = [(1, None, "k", 1), (1, None, "k", 1), (2, "", "k", 1), (None, "a@b.cd", "k", 1), (3, "x" * 300_000 + " a@b.cd and bob at example dot com " + "1." * 100_000, "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind int")
    got = sorted(((r["doc_id"], [tuple(s) for s in r["spans"]][:2]) for r in disguised_pii.find(docs).collect()), key=str)
    assert got == sorted([(1, []), (1, []), (2, []), (None, [("email", 0, 6, True)]), (3, [("email", 300_001, 300_007, True), ("email", 300_012, 300_034, False)])], key=str)
    hidden = disguised_pii.masked(docs)
    assert hidden.columns == docs.columns
    assert [r["text"] for r in hidden.filter("doc_id is null").collect()] == ["<EMAIL>"]
    assert "<EMAIL> and <EMAIL> " in hidden.filter("doc_id = 3").first()["text"]
    assert disguised_pii.find(docs.filter("false")).count() == 0 and disguised_pii.masked(docs.filter("false")).count() == 0


# ---- filter audit


def audit_by_brute_force(docs, good, toxic):
    fails, seen, sources = {}, {}, {}
    for i, text, _ in docs:
        if i is not None:
            seen[text or ""] = min(i, seen.get(text or "", i))
    for n, (i, text, source) in enumerate(docs):
        t, words = text or "", [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        on = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > seen[t]}
        fails[n], sources[n] = {f for f, x in on.items() if x}, source or ""
    out, removed_by = [], {}
    for part in set(sources.values()):
        rows = [n for n in fails if sources[n] == part]
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left, before = [n for n in left if f in fails[n]], [n for n in left if f not in fails[n]], len(left)
                assert before == len(gone) + len(left)
                unique = sum(fails[n] == {f} for n in rows)
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
                out.append((part, order, step, len(left), len(gone), sum(f in fails[n] for n in rows) - len(gone), unique, sum(docs[n][0] in good for n in gone), sum(docs[n][0] in toxic for n in gone)))
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


def test_op13_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    want = audit_by_brute_force(docs, {r["doc_id"] for r in labels if r["quality"] == 1}, {r["doc_id"] for r in labels if r["toxic"] == 1})
    got = queries.op13_filter_audit(spark, SF)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_op13_edge_cases(spark):
    many = " ".join(f"w{k}" for k in range(250))
    rows = [(1, None, None), (2, "", ""), (None, many, "s"), (4, many, "s"), (3, many, "t"), (4, many, "s"), (5, many + "\x0b\x0c #", "t"), (6, "  É" * 300, "t"), (7, "A " * 400, "u")]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, source string, part string, n int")
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 1), (4, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).filter("not whole").drop("whole", "filter")
    assert sorted(tuple(r) for r in got.collect()) == audit_by_brute_force(rows, {3, 4}, {3})
    whole = filter_audit.audit(docs, labels).filter("whole")
    assert whole.count() == 600 and sorted(tuple(r)[2:8] for r in whole.drop("filter").collect()) == sorted(r[1:7] for r in audit_by_brute_force([(i, t, "x") for i, t, _ in rows], {3, 4}, {3}))
    assert filter_audit.audit(docs.filter("false"), labels).count() == 0
    assert filter_audit.audit(docs, labels.filter("false")).filter("good_lost <> 0 or toxic_lost <> 0").count() == 0
    with pytest.raises(ValueError):
        filter_audit.subset_survivors(docs, tuple("ABCDEFG"))
    assert math.factorial(5) * 5 == 600
