"""Small brute-force comparisons and edge cases of the training-data operators."""

import hashlib
import re
import zlib
from math import ceil, log2

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from icewake.llm import (
    best_fit_packing,
    chat_rotation,
    components,
    hilbert_neighbours,
    image_copies,
    linked_groups,
    license_scan,
    lm_scores,
    media_scenes,
    quality_crf,
    queries,
    sentencepiece_codec,
    simhash_dedup,
    suffix_array_dedup,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, key string, score double"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{k % 977} é{k % 89}" for k in range(9000))
ODD = [None, "", " ", "\n\n", "a", "one two", "  two  blanks ▁ x\t", "ÀÉ ß 😀 <unk> <|endoftext|> ok", "it's 12's\r\n" * 40, LONG, LONG, LONG[:5000] + " changed " + LONG[5000:]]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", "k", 0.5) for k, t in enumerate(ODD)] + [(3, "\n\n", "en", "k", 0.5)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())


def removed_by_brute_force(texts, n=100):
    seen, out = set(), {}
    for d in sorted(texts):
        x = texts[d].encode()
        cut = np.zeros(len(x) + 1, dtype=int)
        for i in range(len(x) - n + 1):
            w = hashlib.blake2b(x[i : i + n], digest_size=12).digest()
            if w in seen:
                cut[i] += 1
                cut[i + n] -= 1
            seen.add(w)
        gone = np.cumsum(cut[:-1]) > 0
        kept = bytes(np.frombuffer(x, dtype=np.uint8)[~gone])
        out[d] = (len(x), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_op1_equals_brute_force(spark, real):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op1_suffix_array_dedup(spark, SF).collect()}
    assert got == removed_by_brute_force(real)


def test_op1_edge_cases(spark, odd, none):
    got = {r["doc_id"]: r for r in suffix_array_dedup.removed_runs(odd).collect()}
    want = removed_by_brute_force({k: t or "" for k, t in enumerate(ODD)})
    for d, r in got.items():
        assert hashlib.sha256(r["kept"]).hexdigest() == want[d][3]
    assert suffix_array_dedup.removed_runs(none).count() == 0
    short = suffix_array_dedup.without_repeats(odd)
    assert short.columns == odd.columns and short.count() == odd.count()
    assert [r["text"] for r in short.filter("doc_id = 10").collect()] == [""]
    assert suffix_array_dedup.without_repeats(none).count() == 0


def test_op1_shuffles_the_documents_once(spark):
    def written():
        jvm = spark._jvm
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    rng = np.random.default_rng(5)
    texts = [rng.bytes(2000).hex() for _ in range(300)]
    texts[7], texts[200] = texts[7] + texts[3][:150], texts[9][700:1000] + texts[200]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*texts, None])] + [(None, texts[0], 9)], "doc_id long, text string, n_chars int")
    none, cost = written(), []
    for query in (lambda d: d.sparkSession.createDataFrame(d.repartition("doc_id").collect(), d.schema), suffix_array_dedup.without_repeats, suffix_array_dedup.removed_runs):
        rows = query(docs).collect()
        cost.append(written() - none)
        none += cost[-1]
        if query is suffix_array_dedup.without_repeats:
            assert {r["doc_id"]: tuple(r)[1:] for r in rows} == dict(enumerate((t, 1) for t in [*texts, None])) | {7: (texts[7][:4000], 4000), 200: (texts[200][300:], 4000), None: (texts[0], 9)}
    once, cut, runs = cost
    assert once > 0 and max(cut, runs) < 2.5 * once  # anchors of segments take about as much again


def test_repeated_ids_are_cut_each_by_their_own_text(spark):
    head, tail = "".join(f"é{k}," for k in range(80)), "".join(f"{k};" for k in range(100, 180))
    docs = spark.createDataFrame([(1, head), (5, "short"), (5, tail + head), (6, None), (None, head)], "doc_id int, text string")
    got = [tuple(r) for r in suffix_array_dedup.without_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, head), (5, "short"), (5, tail), (6, None), (None, head)], key=str)


def test_suffix_classes_are_those_of_sorted_suffixes():
    rng = np.random.default_rng(1)
    strings = [bytes(rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8)) for _ in range(12)]
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), dtype=np.uint8)
    order, new = suffix_array_dedup.shared_prefix_classes(text, 6)
    raw = text.tobytes()
    kinds = {}
    for position, group in zip(order.tolist(), np.cumsum(new).tolist()):
        s = raw[position:].split(b"\xff")[0]
        if len(s) >= 6:
            assert kinds.setdefault(group, s[:6]) == s[:6]
    assert len(set(kinds.values())) == len(kinds)


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op2_equals_brute_force(spark, real):
    ids = sorted(real)
    prints = np.array([brute_fingerprint(real[d]) for d in ids], dtype=np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    want = {d: (f"{int(f):016x}", ids[find(i)]) for i, (d, f) in enumerate(zip(ids, prints))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash_dedup(spark, SF).collect()} == want


@pytest.mark.parametrize("bucket", [4096, 8])
def test_hamming_links_are_complete(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 4), replace=False)) for b in base for _ in range(25)})
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs, words: docs.selectExpr("id as doc_id", "fp"))
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(prints)), "id long, fp long")).collect()}
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    assert got == dict(enumerate(root))


def test_near_copies_go_and_others_stay(spark, odd, none):
    kept = {r["doc_id"] for r in simhash_dedup.one_of_each(odd).collect()}
    assert 9 in kept and 10 not in kept and 11 not in kept and {4, 5, 6, 7, 8} <= kept
    assert simhash_dedup.one_of_each(odd).columns == odd.columns
    assert simhash_dedup.one_of_each(none).count() == 0 and simhash_dedup.near_duplicates(none).count() == 0


def shingles(text, n=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("bucket", [4096, 16])
def test_similar_classes_equal_brute_force(spark, monkeypatch, bucket):
    # pairs on both sides of 0.8, a large group of near copies, and texts alone
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    rng = np.random.default_rng(8)
    texts = []
    for k in range(150):
        base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        copy = list(base)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            copy[at] = "x"
        texts += [" ".join(base), " ".join(copy)]
    base = [f"g{x}" for x in rng.integers(0, 5000, 200)]
    for k in range(60):
        copy = list(base)
        copy[k] = copy[k + 100] = f"edit{k}"
        texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert sum(i < 300 for i, _ in want) > 60 and sum((2 * k, 2 * k + 1) not in want for k in range(150)) > 20
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_classes(frame).collect()}
    linked = [(i, j) for i, j in want if got[i] == got[j]]
    assert len(linked) >= 0.95 * len(want) and {got[k] for k in range(300, 360)} == {300}
    assert all((2 * k, 2 * k + 1) in want or got[2 * k + 1] == 2 * k + 1 for k in range(150))


def test_extra_columns_with_clashing_names_survive(spark):
    names = ["copy_id", "cut_id", "cuts", "node", "fp", "key", "id", "component_id", "bytes", "oid", "content"]
    text = " ".join(f"word{k}" for k in range(60))
    frame = spark.createDataFrame([(1, text, *"abcdefghijk"), (2, text, *"abcdefghijk"), (3, "alone", *"abcdefghijk")], f"doc_id long, text string, {', '.join(n + ' string' for n in names)}")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r["doc_id"] for r in simhash_dedup.one_of_each(frame).collect()) == [1, 3]
    short = suffix_array_dedup.without_repeats(frame)
    assert short.columns == frame.columns and {r["doc_id"]: (r["text"], r["cuts"]) for r in short.collect()}[2] == ("", "c")
    assert quality_crf.without_bad(frame, labels).columns == frame.columns
    assert {r["doc_id"] for r in best_fit_packing.pack(frame, BPE, 64).collect()} == {1, 2, 3}
    assert suffix_array_dedup.removed_runs(frame).count() == sentencepiece_codec.encode_decode(frame, PIECES).count() == lm_scores.score_documents(frame).count() == 3
    assert license_scan.scan(frame, license_scan.train(frame)).count() == 0


def test_op3_finds_edited_views(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").limit(96)
    rows = {r["image_id"]: r for r in image_copies.copy_classes(media_scenes.pictures(vectors)).collect()}
    edited = [k for k in rows if k % 8 == 7 and k - 1 in rows]
    assert np.mean([rows[k]["class_id"] == rows[k - 1]["class_id"] for k in edited]) >= 0.9
    assert all(rows[k]["class_id"] == k for k in rows if k % 8 < 7)
    odd = spark.createDataFrame([(1, None, None, None), (2, 4, 4, b"abc"), (3, 4, 4, bytes(16)), (4, 4, 4, bytes(16))], "image_id long, width int, height int, pixels binary")
    assert {r["image_id"]: r["class_id"] for r in image_copies.copy_classes(odd).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    assert image_copies.copy_classes(odd.limit(0)).count() == 0


def _points(rng, layout, patches, shift=0.0):
    p = np.empty(len(layout), dtype=image_copies._POINT)
    p["x"], p["y"] = layout[:, 0] + shift, layout[:, 1]
    p["bits"], p["weak"] = patches, 0
    return p


def _linked(spark, images):
    frame = spark.createDataFrame([(k, bytearray(p.tobytes())) for k, p in images.items()], "image_id long, points binary")
    return sorted((r["a"], r["b"]) for r in image_copies.copy_links(frame).collect())


def test_op3_links_in_large_tables_do_not_hang_on_the_first_image(spark):
    # 82 images have the same six patches; only images 50 and 51 have them in one layout
    rng = np.random.default_rng(1)
    patches, layout = rng.integers(0, 256, (6, 32)), rng.uniform(0, 1000, (6, 2))
    images = {k: _points(rng, layout if k in (50, 51) else rng.uniform(0, 1000, (6, 2)), patches, 30.0 * (k == 51)) for k in range(82)}
    assert _linked(spark, images) == [(50, 51)]


def test_op3_common_corners_lose_no_link(spark):
    # 90 images share four patches; images 10 and 20 share five more in one layout
    rng = np.random.default_rng(2)
    logo, own, at = rng.integers(0, 256, (4, 32)), rng.integers(0, 256, (5, 32)), rng.uniform(0, 500, (9, 2))
    images = {k: _points(rng, at if k in (10, 20) else rng.uniform(0, 500, (9, 2)), np.concatenate([logo, own if k in (10, 20) else rng.integers(0, 256, (5, 32))])) for k in range(90)}
    assert _linked(spark, images) == [(10, 20)]


@pytest.mark.parametrize("n", [40, 80])
def test_op3_links_that_meet_at_common_corners_only(spark, n):
    # all share four corners; the ten own corners of images 1 and 2 differ in three bits of every table and so never meet
    rng = np.random.default_rng(3)
    logo, own, at = rng.integers(0, 256, (4, 32)), rng.integers(0, 2, (10, 256)), rng.uniform(0, 500, (14, 2))
    other = own.copy()
    for which in image_copies.table_bits():
        other[:, which[5:8]] ^= 1
    both = {1: own, 2: other}
    images = {}
    for k in range(n):
        patches = np.packbits(both[k], axis=1, bitorder="little") if k in both else rng.integers(0, 256, (10, 32))
        images[k] = _points(rng, at if k in both else rng.uniform(0, 500, (14, 2)), np.concatenate([logo, patches]))
    assert image_copies.consensus(images[1], images[2]) == 14 and _linked(spark, images) == [(1, 2)]


def _view(a, angle=0.0, ratio=1.0, side=None):
    """Bilinear view of ``a``, turned and rescaled about its middle."""
    side = side or int(min(a.shape) / 1.5)
    y, x = np.mgrid[:side, :side] - (side - 1) / 2
    c, s = np.cos(angle) / ratio, np.sin(angle) / ratio
    sx, sy = c * x - s * y + (a.shape[1] - 1) / 2, s * x + c * y + (a.shape[0] - 1) / 2
    i, j = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = sy - i, sx - j
    return (a[i, j] * (1 - fy) + a[i + 1, j] * fy) * (1 - fx) + (a[i, j + 1] * (1 - fy) + a[i + 1, j + 1] * fy) * fx


def _photograph(seed, side=256):
    rng = np.random.default_rng(seed)
    a, at = np.full((side, side), 128.0), np.arange(side) / (side - 1)
    for cells, depth in ((4, 40), (12, 40), (32, 40), (64, 30)):
        w = np.maximum(0, 1 - np.abs(at[:, None] * cells - np.arange(cells + 1)))
        a += depth * (w @ rng.uniform(-1, 1, (cells + 1, cells + 1)) @ w.T)
    return a


@pytest.mark.parametrize(("angle", "ratio", "side", "least"), [(0, 1, 128, 1.0), (90, 1, 128, 1.0), (15, 1, 150, 0.9), (45, 1, 150, 0.9), (0, 1.1, 170, 0.9), (0, 1.22, 170, 0.9), (0, 1.35, 170, 0.9), (0, 1.5, 170, 0.9), (0, 0.82, 150, 0.9), (0, 0.67, 150, 0.9)])
def test_op3_views_of_large_images(angle, ratio, side, least):
    turned, agreed, met = image_copies.turned_tests(), 0, 0
    for k in range(12):
        a = _photograph(k)
        first, second = (image_copies.describe(np.clip(np.rint(x), 0, 255).astype(np.uint8)[None], turned)[0] for x in (a, _view(a, np.radians(angle), ratio, side) * 1.05 + 4))
        agreed += image_copies.consensus(first, second) >= image_copies.CONSENSUS
        values = [set() for _ in range(2)]
        for x, seen in zip((first, second), values):
            for p in x:
                for t, which in enumerate(image_copies.table_bits()):
                    bits = np.unpackbits(p["bits"], bitorder="little")[which]
                    seen |= {(t, bits.tobytes()), (t, (bits ^ (np.arange(len(which)) == p["weak"][t])).astype(np.uint8).tobytes())}
        met += bool(values[0] & values[1])
    assert agreed / 12 >= least and met / 12 >= least


def test_op3_tables_lose_few_of_the_links_of_all_pairs(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").limit(160)
    found = image_copies.described(media_scenes.pictures(vectors)).toPandas()
    points = {k: np.frombuffer(p, dtype=image_copies._POINT) for k, p in zip(found.image_id, found.points)}
    ids = sorted(points)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if image_copies.consensus(points[a], points[b]) >= image_copies.CONSENSUS}
    got = set(_linked(spark, points))
    assert len(want) > 10 and got <= want and len(got) >= 0.9 * len(want)


def test_components_of_a_long_path_and_a_hub(spark, monkeypatch):
    rounds = []
    keep = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, label: rounds.append(label) or keep(df, label))
    path = spark.range(999).selectExpr("id as a", "id + 1 as b")
    rows = components.connected_components(path).collect()
    assert len(rows) == 1000 and {r["root"] for r in rows} == {0}
    assert rounds.count("jump") + rounds.count("chain") <= 15
    hub = spark.range(300).selectExpr("id as a", "1000 as b").union(spark.range(2).selectExpr("2000 + id as a", "2001 + id as b"))
    roots = {r["node"]: r["root"] for r in components.connected_components(hub).collect()}
    assert {roots[k] for k in [*range(300), 1000]} == {0} and {roots[k] for k in (2000, 2001, 2002)} == {2000}


def test_op4_held_out_accuracy(spark):
    rows = queries.op4_quality_crf(spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchdf()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > max(0.9, both.quality.mean())
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id]).all()


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lines_of, link = np.array([1, 4, 3]), rng.normal(size=(2, 2))
    emission = rng.normal(size=8)
    marginal, expected, log_z = quality_crf.forward_backward(emission, lines_of, link)
    at, links = 0, np.zeros((2, 2))
    for d, n in enumerate(lines_of):
        e = emission[at : at + n]
        paths = [[p >> k & 1 for k in range(n)] for p in range(1 << n)]
        weight = np.array([np.exp(sum(e[k] * p[k] for k in range(n)) + sum(link[p[k], p[k + 1]] for k in range(n - 1))) for p in paths])
        assert log_z[d] == pytest.approx(np.log(weight.sum()))
        share = weight / weight.sum()
        assert marginal[at : at + n] == pytest.approx(sum(w * np.array(p) for w, p in zip(share, paths)))
        for w, p in zip(share, paths):
            for a, b in zip(p, p[1:]):
                links[a, b] += w
        at += n
    assert expected == pytest.approx(links)


def test_quality_edge_cases(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    scored = quality_crf.score_documents(odd, quality_crf.train(odd, labels), "s").collect()
    assert len(scored) == odd.count() and all(0 <= r["s"] <= 1 for r in scored)
    assert quality_crf.without_bad(odd, labels).columns == odd.columns
    assert quality_crf.without_bad(none, labels).count() == 0
    assert quality_crf.train(odd, labels.limit(0)).constant == 0.5


def test_op5_equals_the_library(spark, odd, none, real):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {k: t or "" for k, t in enumerate(ODD)}
    for frame, want in ((odd, texts), (spark.createDataFrame(list(real.items()), "doc_id long, text string"), real)):
        for r in sentencepiece_codec.encode_decode(frame, PIECES).collect():
            ids = lib.encode(want[r["doc_id"]], add_bos=True, add_eos=True)
            assert np.frombuffer(r["ids"], dtype="<u4").tolist() == ids and r["decoded"] == lib.decode(ids)
    assert sentencepiece_codec.encode_decode(none, PIECES).count() == 0


def test_op6_pieces_and_places(spark, odd, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    rows = best_fit_packing.pack(odd.dropDuplicates(["doc_id"]), BPE, 2048).collect()
    for d, t in enumerate(ODD):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) - (len(ids) - 1) // 2048 * 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == d)
        assert own == [(k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[-1][0] + p[-1][1] <= 2048
    assert best_fit_packing.pack(none, BPE, 2048).count() == 0


def test_bins_use_all_and_fit():
    rng = np.random.default_rng(5)
    histogram = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 40), rng.integers(1, 30, 40))}
    used, bins = {}, 0
    for lengths, times in best_fit_packing.plan_bins(dict(histogram), 100):
        assert sum(lengths) <= 100
        bins += times
        for x in lengths:
            used[x] = used.get(x, 0) + times
    room = []  # plain best-fit decreasing
    for x in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits)[1]] -= x
        else:
            room.append(100 - x)
    assert used == histogram and bins <= len(room)


def duck_rows(sql, **tables):
    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame.toPandas())
    return sorted(map(tuple, c.execute(sql).fetchall()), key=repr)


def test_op7_equals_sql_on_ties_and_nulls(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 2000, "c d", "late"), (2, 0, "system", "alone"), (3, 0, None, "x"), (4, 5, "ann", "é😀")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    columns = ["conv_id", "perspective", "turn", "role", "speaks_as", "segment", "start", "mask_start", "mask_end"]
    assert sorted(map(tuple, chat_rotation.rotate(frame).select(columns).collect()), key=repr) == duck_rows(f"select {', '.join(columns)} from ({chat_rotation.ORACLE})", conversations=frame)
    assert chat_rotation.rotate(frame.limit(0)).count() == 0
    loose = spark.createDataFrame([(None, None, "a", "x"), (None, None, "b", "y")], frame.schema)
    assert chat_rotation.rotate(loose).count() == 4


def test_op8_equals_sql(spark, real, odd, none):
    frame = spark.createDataFrame(list(real.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["log_score"]) for r in lm_scores.score_documents(frame).collect()}
    for d, n, s in duck_rows(f"select doc_id, n_words, log_score from ({lm_scores.ORACLE})", documents=frame):
        assert got[d][0] == n and got[d][1] == pytest.approx(s, abs=1e-4)
    assert lm_scores.score_documents(none).count() == 0
    assert {r["doc_id"]: r["n_words"] for r in lm_scores.score_documents(odd).collect()}[0] == 0


def test_op8_equals_sql_on_odd_rows(spark):
    rows = [(1, "a b a b"), (1, "b c"), (None, "a b c"), (None, "c"), (2, None), (3, " "), (4, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], round(r["log_score"], 4)) for r in lm_scores.score_documents(frame).collect()), key=repr)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert got == sorted(con.execute(f"select doc_id, n_words, log_score from ({lm_scores.ORACLE})").fetchall(), key=repr)


def test_op8_rare_words_stay_apart(spark, monkeypatch):
    # 70,000 words that occur once, more than VOCABULARY: as one unknown word each would score as if it were frequent
    rows = [(0, "the sea the sea"), (1, "sea"), (2, " ".join(f"junk{k}" for k in range(70_000)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (2_500_000, 2):
        monkeypatch.setattr(lm_scores, "BATCH_WORDS", words)
        got = {r["doc_id"]: r["log_score"] for r in lm_scores.score_documents(frame).collect()}
        total = np.log(70_005)
        assert got[0] == pytest.approx(np.log(2) - total + np.log(2 / 2) + np.log(1 / 3) + np.log(2 / 2))
        assert got[1] == pytest.approx(np.log(3) - total)
        assert got[2] == pytest.approx(-total)


def test_op9_finds_notices_and_leaves_prose(spark, odd, none):
    model = license_scan.fit([p.split() for p in (b"the river is wide and calm", b"she wrote a letter to the office", b"un texte sans licence aucune")])
    notices = {"mit": "x Released under the MIT License.", "apache-2.0": "Licensed under the Apache License, Version 2.0.", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    text = "\n".join(["The license was renewed by the office.", *notices.values(), "A quiet day."])
    rows = license_scan.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), model).collect()
    assert [(r["paragraph"], r["family"]) for r in sorted(rows, key=lambda r: r["paragraph"])] == list(enumerate(notices, 1))
    assert all(r["confirmed"] for r in rows)
    assert license_scan.scan(none, model).count() == 0 and license_scan.scan(odd, license_scan.train(odd)).count() == 0


@pytest.fixture(scope="module")
def licences():
    rng = np.random.default_rng(8)
    noise = [[b"w%d" % k for k in rng.integers(0, 500, 12)] for _ in range(40)]
    return license_scan.fit([*noise, *(p.split() for p in (b"the river is wide and calm", b"she wrote a letter to the office", b"version 2 of the plan"))])


def findings_by_brute_force(model, text):
    """Every paragraph under the model alone, gram by gram in plain Python."""

    def likeliest(words):
        best = None
        for s in range(0, max(len(words) - license_scan.WINDOW // 2, 1), license_scan.WINDOW // 2):
            part = words[s : s + license_scan.WINDOW]
            held = {model.grams[g] for g in {tuple(part[i : i + n]) for n in (1, 2, 3) for i in range(len(part) - n + 1)} if g in model.grams}
            z = (model.bias + sum(model.weight[r] for r in held) / max(len(held), 1) ** 0.5) / model.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            if held and p.argmax() and p.max() >= license_scan.CONFIDENCE and (best is None or p.max() > best[1] + 1e-12):
                best = (model.families[int(p.argmax())], p.max())
        return best

    out, lines = [], []
    for k, line in enumerate([*(text or "").split("\n"), ""]):
        words = [w.encode() for w in re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))]
        lines += [(k, words)] if words else []
        if lines and (not words or re.search("[.!?][ \t\r\"'*/)]*$", line)):
            whole = likeliest([w for _, ws in lines for w in ws])
            out += [(lines[0][0], *whole)] if whole else [(n, *f) for n, ws in lines if len(lines) > 1 and (f := likeliest(ws))]
            lines = []
    return out


def test_op9_equals_the_model_on_every_paragraph(spark, licences, real, monkeypatch):
    monkeypatch.setattr(license_scan, "AT_ONCE", 300)
    rng = np.random.default_rng(9)
    known = sorted({w.decode() for g in licences.grams for w in g})
    drawn = [" ".join(rng.choice([*known, "zebra", "plain", "\n", "\n", ".\n", "\n\n"], int(rng.integers(1, 300)))) for _ in range(60)]
    texts = dict(enumerate([*ODD, *drawn, *list(real.values())[:40], "License: MIT", "Quoted MIT License.\n" * 3]))
    rows = license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), licences).collect()
    want = {(d, n): (f, p) for d, t in texts.items() for n, f, p in findings_by_brute_force(licences, t)}
    got = {(r["doc_id"], r["paragraph"]): (r["family"], r["probability"]) for r in rows}
    assert len(got) == len(rows) > 40 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert [v[1] for _, v in sorted(got.items())] == pytest.approx([v[1] for _, v in sorted(want.items())], abs=1e-9)


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("License: MIT", "mit"),
        ('"license": "MIT",', "mit"),
        ('{\n "name": "x",\n "version": "2.0.0",\n "license": "ISC",\n "author": "the one"\n}', "isc"),
        ("License: BSD-3-Clause", "bsd"),
        ('license = "Apache-2.0"', "apache-2.0"),
        (" * under the terms of the GNU General Public License,\n * version 3.", "gpl-3.0"),
        ("w1 w2 w3 " * 400 + "this work is licensed under the MIT License " + "w4 w5 " * 400, "mit"),
        ("mit", None),
        ("Er geht mit dem Hund in die Stadt", None),
        ("she studied at MIT", None),
        ("version 2.0", None),
        ("the general public", None),
    ],
)
def test_op9_short_wrapped_and_long_paragraphs(licences, text, family):
    found = [f for lines in license_scan.paragraphs(text) for f in licences.findings([license_scan._joined(lines)])]
    found += [f for lines in license_scan.paragraphs(text) if found == [None] for _, words in lines for f in licences.findings([words])]
    assert {f[0] for f in found if f} == ({family} if family else set())


def test_op9_probabilities_are_calibrated(licences):
    """Unseen variants of notices and of near misses: mean confidence is close to the share that is right."""
    rng = license_scan.random.Random(77)
    noise = [[b"w%d" % rng.randrange(500) for _ in range(12)] for _ in range(40)]
    cases = [*license_scan._variants(rng, noise), *((0, w) for w in noise for _ in range(10))]
    p, _ = licences.probabilities([w for _, w in cases])
    right = p.argmax(axis=1) == [k for k, _ in cases]
    unknown = np.array([k == 0 for k, _ in cases])
    assert abs(p.max(axis=1).mean() - right.mean()) < 0.05 and right.mean() > 0.9 and right[unknown].mean() > 0.95


def test_hilbert_index_walks_to_adjacent_cells():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_neighbours.hilbert_index(cells, 3)
    walk = cells[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize(("spread", "most"), [(None, 1.0), (0.05, 0.1)])
def test_op10_visits_fewer_rows_than_brute_force(spread, most):
    # without structure a little less than all rows, in clusters few
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    if spread:
        x = rng.normal(size=(400, 64))[rng.integers(0, 400, len(x))] + spread * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    sample, queries = x[:5000], x[::200]
    d = np.argsort(-(queries @ x.T), axis=1, kind="stable")[:, 1:11]
    curves = hilbert_neighbours.Curves(sample, hilbert_neighbours.CURVES, hilbert_neighbours.DIMENSIONS, hilbert_neighbours.BITS)
    gaps = hilbert_neighbours.rank_gaps(curves, sample, np.repeat(queries, 10, axis=0), x[d.reshape(-1)])
    chosen, window = hilbert_neighbours.cheapest(gaps, hilbert_neighbours.COVERAGE)
    met = visits = 0
    keys = [curves.keys(x, c) for c in range(chosen)]
    for c in range(chosen):
        place = np.empty(len(x), dtype=int)
        place[np.argsort(keys[c], kind="stable")] = np.arange(len(x))
        at = place[::200]
        visits += sum(min(len(x), p + window * len(x)) - max(0, p - window * len(x)) for p in at)
        met = met | (np.abs(place[d] - at[:, None]) <= window * len(x))
    assert visits <= most * len(queries) * len(x) and met.mean() >= 0.9


def test_op10_recall_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(hilbert_neighbours, "BLOCK", 64)
    rng = np.random.default_rng(2)
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [2.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="several lengths"):
        hilbert_neighbours.nearest(mixed)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(k, [float(v) for v in x[k]]) for k in range(1500)] + [(1500 + k, [float(v) for v in x[0]]) for k in range(40)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] + [1.0] * 15), (None, [1.0] * 16), (5400, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in hilbert_neighbours.nearest(frame, length=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([k for k, _ in rows[:1540]])
    full = np.array([v for _, v in rows[:1540]], dtype=np.float64)
    assert sorted(got) == [k for k in ids.tolist() if k % 100 == 0]
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((full - full[q]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, d)).tolist() if k != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [s for _, _, s in found] == pytest.approx([d[v] for _, v, _ in found], abs=1e-12)
        hits += len(set(order) & {v for _, v, _ in found})
    assert hits / (10 * len(got)) >= 0.9
    assert [v for _, v, _ in got[0]] == list(range(1500, 1510)) and [v for _, v, _ in got[1500]] == [0, *range(1501, 1510)]
    assert hilbert_neighbours.nearest(frame.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 3:
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = out
    assert out.agg({"length": "max"}).first()[0] <= 2048


def test_near_copies_below_the_similarity_make_few_candidates(spark, monkeypatch):
    """120 texts of one, three words of each exchanged, are 0.735 alike: nearly all of their 7,140 pairs are too near for SimHash to tell from 0.8."""
    rng, seen, compare = np.random.default_rng(9), [], simhash_dedup._similar_pairs
    base = [f"w{k}" for k in range(200)]

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(simhash_dedup, "_similar_pairs", counted)
    texts = []
    for k in range(120):
        own = list(base)
        for place in rng.choice(np.arange(5, 195, 10), 3, replace=False):
            own[place] = f"x{k}_{place}"
        texts.append(" ".join(own))
    sets = [set(simhash_dedup.shingle_hashes(t, 5).tolist()) for t in texts]
    linked = sum(len(x & y) >= 0.8 * len(x | y) for k, x in enumerate(sets) for y in sets[:k])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_classes(frame).collect()}
    assert len(got) == 120 and sum(seen) <= linked + 200


def test_parities_lose_no_similar_pair(spark):
    """Sets around both sides of 0.8, of all their shingles, of drawn ones and of two levels; of all shingles next to no pair at 0.7 is left."""
    rng, rows, alike = np.random.default_rng(3), [], []
    for size in (0, 1, 9, 150, 400, 500, 900, 1020, 3000):
        for k in range(40):
            share = (1.0, 0.95, 0.8, 0.7)[k % 4]
            one = rng.integers(0, 1 << 63, size + size // 5, dtype=np.uint64)
            apart = ceil(size * (1 - share) / (1 + share)) if share != 0.8 else size // 9  # on each side
            more = rng.integers(0, 1 << 63, apart, dtype=np.uint64)
            x, y = one[:size], np.concatenate([one[apart:size], more])
            if k % 8 == 2 and size:
                y = one[: size + size // 5]  # one holds the other
            rows.append(tuple(v for own in (x, y) for v in _parity_row(own)))
            alike.append(simhash_dedup.jaccard(np.unique(x), np.unique(y)))
    kind = ", ".join(f"{n} struct<size:long,level:long,odd:array<long>>" for n in ("one", "two"))
    frame = spark.createDataFrame([(k, r[:3], r[3:]) for k, r in enumerate(rows)], f"k long, {kind}")
    left = {r["k"] for r in frame.filter(simhash_dedup._possible(0.8)).collect()}
    assert left >= {k for k, j in enumerate(alike) if j >= 0.8}
    assert not [k for k in left if alike[k] < 0.72 and 100 <= rows[k][0] <= simhash_dedup.WHOLE]
    assert {r[k] for r in rows for k in (1, 4)} == {0, 1, 2, 3} and any(r[1] != r[4] and j >= 0.8 for r, j in zip(rows, alike))


def _parity_row(own):
    size, level = len(own), ceil(log2(max(len(own) / simhash_dedup.WHOLE, 1)))
    return size, level, np.concatenate([simhash_dedup.parities(own, level + up) for up in (0, 1)]).view(np.int64).tolist()


def test_links_under_several_keys_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    met = sorted({(int(k), int(i)) for i in range(120) for k in rng.integers(0, 25, 6)})
    linked = lambda a, b: (a * 7 + b * 13) % 17 == 0
    close = lambda a, b: abs(a - b) <= 60
    want = {(a, b) for k, a in met for m, b in met if k == m and a < b and linked(a, b) and close(a, b)}
    near = F.abs(F.col("one.id") - F.col("two.id")) <= 60
    frame = spark.createDataFrame(met, "key long, id long")
    got = linked_groups.class_links(frame, lambda pairs: pairs.filter((F.col("a") * 7 + F.col("b") * 13) % 17 == 0), near)
    edges = {(r["a"], r["b"]) for r in got.collect()}
    assert edges <= want

    def classes(edges):
        root = list(range(120))
        for a, b in list(edges) * 120:
            root[a] = root[b] = min(root[a], root[b])
        return root

    assert classes(sorted(edges)) == classes(sorted(want))


def test_links_of_a_long_chain_under_one_key_take_few_pairs(spark):
    """No id is linked with more than two others: leaders alone join nothing, and the turns must end."""
    frame = spark.range(1500).select(F.lit(7).cast("long").alias("key"), "id").union(spark.range(1500).select((F.col("id") % 5).alias("key"), "id"))
    near, seen = F.abs(F.col("one.id") - F.col("two.id")) <= 3, []

    def verified(pairs):
        seen.append(pairs.count())
        return pairs.filter("b - a = 1")

    edges = {(r["a"], r["b"]) for r in linked_groups.class_links(frame, verified, near).collect()}
    assert edges == {(k, k + 1) for k in range(1499)}
    assert sum(seen) <= 3 * 1500 and len(seen) <= 7  # turns of 1, 1, 4, 16, 64 and 256 leaders, then all
    assert linked_groups.class_links(frame.limit(0), verified, near).count() == 0


def test_rows_of_keys_still_apart_are_found_without_a_join(spark, monkeypatch):
    """Many ids under many common keys in several classes: what stays is no join's output, and the links are those of brute force."""
    plans, write = {}, linked_groups.materialise
    monkeypatch.setattr(linked_groups, "materialise", lambda df, label: plans.setdefault(label, []).append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, label))
    frame = spark.range(60 * 20).select((F.col("id") % 20).alias("key"), F.expr("id div 20").alias("id"))
    edges = {(r["a"], r["b"]) for r in linked_groups.class_links(frame, lambda pairs: pairs.filter("b - a = 4")).collect()}
    assert edges == {(k, k + 4) for k in range(56)}
    assert plans["apart"] and not any("Join" in p for p in plans["apart"])
