"""Brute-force comparisons and edge cases of the training-data operators."""

from __future__ import annotations

import random
import re
import zlib
from itertools import accumulate, product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from siftline.llm import cover_tree, golay_simhash, itq_dedup, line_crf, minimax_shards, pair_index_bpe
from siftline.llm import resync_tokens, systematic_mix, toxicity, url_aliases
from siftline.llm.components import connected_components
from siftline.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
WORDS = "the of and ether onand thing stone river water light over under seldom".split()


def docs(spark, rows):
    """Documents with columns that clash with names used inside the operators."""
    table = pa.table(
        {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "text": pa.array([r[1] for r in rows], pa.string()),
            "source": pa.array([r[2] if len(r) > 2 else None for r in rows], pa.string()),
            "fp": pa.array(["x"] * len(rows), pa.string()),
            "key": pa.array([1] * len(rows), pa.int32()),
            "node": pa.array([None] * len(rows), pa.string()),
        }
    )
    return spark.createDataFrame(table)


def odd_rows():
    long = " ".join(random.Random(1).choices(WORDS, k=30_000))
    return [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, long, "b"), (4, long, "b"), (None, "the stone", "b"), (5, "the stone", None), (6, "ends", "é")]


def components_of(links, nodes):
    best = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return best


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (200, 201), (200, 201)]
    nodes = {n for link in links for n in link}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components_of(links, nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 and 7: learned scores -------------------------------------------------


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x = rng.normal(size=(20, 2 * toxicity.WIDTH))
    index = rng.integers(0, 20, (5, toxicity.WINDOW))
    index[0, 3:], index[1] = -1, -1
    target, weights = np.array([0, 1, 1, 0, 1.0]), np.ones(5)

    def loss():
        p = toxicity._sigmoid(net.forward(net.projected(x), index))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()

    grads, d_x = net.gradients(x, index, target, weights)
    for name in ("own_f", "own_b", "in_f", "in_b", "attend", "out", "base_b"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-3
        up = loss()
        net.p[name][at] = kept - 1e-3
        down = loss()
        net.p[name][at] = kept
        assert (up - down) / 2e-3 == pytest.approx(grads[name][at], abs=2e-5)
    assert d_x.shape == x.shape


def test_windows_cover_every_word():
    for n, stride in product((0, 1, 8, 9, 11, 12, 13, 21, 22, 100), (1, toxicity.FIT_STRIDE)):
        index, text = toxicity.window_table(np.arange(n + 3), np.array([n, 3]), stride)
        assert set(index[text == 0].ravel()) - {-1} == set(range(n))
        assert set(index[text == 1].ravel()) - {-1} == {n, n + 1, n + 2}


def test_scores_are_the_highest_of_every_window(spark):
    """Against each window of each text by itself, across texts of a batch, short ones between long ones, and batches."""
    rng = np.random.default_rng(8)
    net = toxicity.Network(3)
    for name in ("word", "char", "out", "attend"):
        net.p[name] = (net.p[name] + rng.normal(0, 1.0, net.p[name].shape)).astype(np.float32)
    sizes = [30, 0, 5000, 1, 12, 11, 13, 3, 40, 12, 400]
    rows = [(i, " ".join(rng.choice(WORDS, n)), "s") for i, n in enumerate(sizes)] + [(90, None, "s"), (91, "7 + 8", "s")]

    def truth(text):
        words = toxicity.words_of(text)
        if not words:
            return float(net.window_scores(net.projected(np.empty((0, 2 * toxicity.WIDTH), np.float32)), np.full((1, toxicity.WINDOW), -1))[0])
        tables = net.projected(net.inputs(toxicity.word_rows(words), *toxicity.char_rows(words)))
        starts = range(max(len(words) - toxicity.WINDOW, 0) + 1)
        windows = [[w if w < len(words) else -1 for w in range(i, i + toxicity.WINDOW)] for i in starts]
        return max(float(net.window_scores(tables, np.array([w]))[0]) for w in windows)

    want = {i: truth(text) for i, text, _ in rows}
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs(spark, rows), net, ["doc_id"], block_chars=700).collect()}
    assert got == pytest.approx(want, abs=1e-4) and len({round(v, 3) for v in want.values()}) > 5


def test_char_rows_name_their_word():
    numbers, rows = toxicity.char_rows(["ab", "c", "déf"])
    assert numbers.tolist() == [0, 0, 1, 2, 2, 2, 2]
    assert (toxicity.char_rows(["c"])[1] == rows[2:3]).all()


def test_labelled_sample_is_one_bounded_row_for_each_id(spark):
    from siftline.llm.common import labelled_sample

    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"text {i}", "s") for i in range(60)] + [(free[0], f"copy {n}", "s") for n in range(500)] + [(None, "x", "s")]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(free[1], 1), (None, 1)], "doc_id long, toxic int")
    some = [labelled_sample(docs(spark, rows).repartition(n), marks, "toxic", 40) for n in (1, 7)]
    assert some[0].equals(some[1]) and len(some[0]) == 40 and set(some[0]["doc_id"]) <= set(free) and some[0]["doc_id"].is_unique
    long = [(i, "y" * (1000 if i % 3 else 10), "s") for i in range(60)]
    bounded = labelled_sample(docs(spark, long), marks, "toxic", 60, max_bytes=3500)
    assert bounded["text"].str.len().sum() == 3160 and (bounded["text"].str.len() == 10).sum() == sum(i % 3 == 0 for i in free)
    assert len(labelled_sample(docs(spark, long), marks, "toxic", 60, max_bytes=5)) == 0


def labelled(spark, good, bad, name):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(400):
        marked = i % 4 == 0
        rows.append((i, (bad if marked else good)(rng), "s"))
        marks.append((i, int(marked) if name == "toxic" else int(not marked)))
    return docs(spark, rows), spark.createDataFrame(marks, f"doc_id long, {name} int")


def prose(rng, n=60):
    return "\n".join(" ".join(rng.choices(WORDS, k=12)) for _ in range(n // 12))


def test_toxicity_held_out(spark):
    def bad(rng):
        words = prose(rng).split()
        words.insert(rng.randrange(len(words)), rng.choice(["grumbly", "snarkish"]))
        return " ".join(words)

    frame, labels = labelled(spark, prose, bad, "toxic")
    rows = toxicity.toxicity(frame, labels, ["doc_id", "fp"]).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)


def test_toxicity_edges(spark):
    frame, labels = docs(spark, odd_rows()), spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(frame, labels, ["doc_id"]).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(docs(spark, []), labels, ["doc_id"]).count() == 0


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    scores, move, counts = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([2, 4, 1])
    good, stay = line_crf.marginals(scores, move, counts)
    for start, n in ((0, 2), (2, 4), (6, 1)):
        total, on, same = 0.0, np.zeros(n), np.zeros(max(n - 1, 0))
        for path in product((0, 1), repeat=n):
            w = np.exp(sum(scores[start + i] * path[i] for i in range(n)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += w
            on += w * np.array(path)
            same += w * np.array([a == b for a, b in zip(path, path[1:])])
        assert good[start : start + n] == pytest.approx(on / total)
        assert stay[start : start + n - 1] == pytest.approx(same / total)


def test_quality_held_out(spark):
    frame, labels = labelled(spark, prose, lambda rng: " ".join(w + "$$$" for w in prose(rng).split()), "quality")
    held = [r for r in line_crf.quality(frame, labels, ["doc_id"]).collect() if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) >= 0.95 * len(held)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert line_crf.quality(docs(spark, odd_rows()), empty, ["doc_id"]).where("predicted = 1").count() == 8
    assert line_crf.quality(docs(spark, []), empty, ["doc_id"]).count() == 0


# ---- 2 and 3: vectors --------------------------------------------------------


def vectors(spark, rows):
    table = pa.table(
        {
            "vec_id": pa.array([r[0] for r in rows], pa.int64()),
            "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())),
            "label": pa.array([r[2] for r in rows], pa.int32()),
            "rank": pa.array([0] * len(rows), pa.int32()),
        }
    )
    return spark.createDataFrame(table)


def tree_points(kind, n=3000, width=6):
    rng = np.random.default_rng(4)
    if kind == "ties":
        return rng.integers(-2, 3, (n, width)).astype(float)
    if kind == "near":
        centres = rng.integers(-900, 900, (12, width))
        return (centres[rng.integers(0, 12, n)] + rng.integers(-20, 20, (n, width))).astype(float)
    return rng.integers(-900, 900, (n, width)).astype(float)


@pytest.mark.parametrize("kind", ["ties", "near", "even"])
def test_cover_tree_invariants(kind):
    points = tree_points(kind)
    order, nodes = cover_tree.build_tree(points, 24)
    assert sorted(order.tolist()) == list(range(len(points)))
    points = points[order]
    for node in nodes:
        low, high, first, count = (int(node[f]) for f in ("low", "high", "first", "children"))
        apart = np.linalg.norm(points[low:high] - points[node["centre"]], axis=1)
        assert apart.max() <= node["radius"] + 1e-9
        assert count <= cover_tree.FAN_OUT + 1 and (not count or (high - low) / count >= cover_tree.FEW - 1)
        if count:
            children = nodes[first : first + count]
            assert children["low"][0] == low and children["high"][-1] == high and (children["low"][1:] == children["high"][:-1]).all()
            assert children["radius"].max() <= node["radius"] / cover_tree.BASE + 1e-9
            centres = points[children["centre"]]
            between = np.linalg.norm(centres[:, None] - centres, axis=2) + np.eye(count) * 1e9
            assert between.min() > node["radius"] / cover_tree.BASE - 1e-9


@pytest.mark.parametrize(("kind", "share"), [("ties", 1.0), ("near", 0.35), ("even", 1.0)])
def test_dual_search(kind, share):
    data = tree_points(kind)
    ids = np.random.default_rng(1).permutation(len(data)).astype(np.int64)
    rows = np.arange(len(data))
    left, right = cover_tree.Tree.of(data[::9], ids[::9], rows[::9], 16), cover_tree.Tree.of(data, ids, rows, 64)
    best = cover_tree.Best(len(left.points), 10)
    scored = cover_tree.dual_search(left, right, best)
    for i in range(len(left.points)):
        mine = best.query == i
        got = sorted(zip(-best.score[mine], best.ids[mine], strict=True))
        exact = sorted((-s, n) for s, n, r in zip(data @ left.points[i], ids, rows, strict=True) if r != left.rows[i])[:10]
        assert got == exact
        assert best.worst[i] == -exact[-1][0]
    assert scored <= share * len(left.points) * len(data)  # where points lie together, node pairs are left out


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.5], 1), (100, [0.25, -1.0], 1), (1, [0.3, 0.3], 1), (1, [0.3, 0.3], 1), (2, None, 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (5, [1.0], 1), (None, [1.0, 1.0], 1), (6, [0.3, 0.3], None)]
    got = [tuple(r) for r in cover_tree.top_k(vectors(spark, rows)).orderBy("query_id", "rank").collect()]
    first, second = 307 * 1024 + 307 * 512, 307 * 256 - 307 * 1024  # both rows of id 1 are candidates
    assert got == [(0, 1, 1, first), (0, 2, 1, first), (0, 3, 6, first), (0, 4, 100, 256 * 1024 - 1024 * 512), (100, 1, 1, second), (100, 2, 1, second), (100, 3, 6, second), (100, 4, 0, 256 * 1024 - 1024 * 512)]
    assert cover_tree.top_k(vectors(spark, [])).count() == 0
    with pytest.raises(Exception, match="pass"):
        cover_tree.top_k(vectors(spark, [(0, [1e30, 0.0], 1), (1, [1.0, 1.0], 1)])).collect()


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", 64)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 16)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCKS", 2)
    monkeypatch.setattr(cover_tree, "LEAF", 8)
    monkeypatch.setattr(cover_tree, "QUERY_LEAF", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 8))
    rows = [(i, (centres[i % 10] + rng.normal(size=8) * 0.05).tolist(), 1) for i in range(1500)]
    rows += [(100, rng.normal(size=8).tolist(), 1), (100, rng.normal(size=8).tolist(), 1)]  # query rows that share an id
    rows += [(2000 + i, rows[0][1], 1) for i in range(700)] + [(5000 + i, [0.1, 0.2, 0.3], 1) for i in range(90)]
    whole = [np.floor(1024 * np.float32(r[1]).astype(float)) for r in rows]
    want = []
    for i, r in enumerate(rows):
        if r[0] % 100 == 0:
            scores = sorted((-int(whole[i] @ v), rows[j][0]) for j, v in enumerate(whole) if j != i and len(v) == len(whole[i]))
            want += [(r[0], n + 1, d, -s) for n, (s, d) in enumerate(scores[:10])]
    measured: list = []
    got = [tuple(r) for r in cover_tree.top_k(vectors(spark, rows), measured=measured).collect()]
    assert sorted(got) == sorted(want)
    assert measured[0][0] < 0.7 * measured[0][1]


def vector_truth(rows, least):
    fine = [i for i, r in enumerate(rows) if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = {i: np.float32(rows[i][1]).astype(float) / np.linalg.norm(np.float32(rows[i][1]).astype(float)) for i in fine}
    links = [(i, j) for i in fine for j in fine if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least]
    return links


def test_vector_groups(spark, monkeypatch):
    monkeypatch.setattr(itq_dedup, "PART_ROWS", 16)  # makes buckets fall into parts
    rng = np.random.default_rng(9)
    rows, near = [], rng.normal(size=(12, 16))
    for i in range(400):
        v = near[i % 12] + rng.normal(size=16) * (0.12 if i % 3 else 1.0)
        rows.append((i, v.tolist(), int(i % 2)))
    rows += [(400 + i, rows[5][1], 1) for i in range(50)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("inf")] * 16, 1), (503, rows[5][1], None), (504, [None] * 16, 1), (505, rows[5][1][:4], 1)]
    links = vector_truth(rows, 0.93)
    degree = np.zeros(len(rows), int)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    got = {r["vec_id"]: r for r in itq_dedup.vector_groups(vectors(spark, rows)).collect()}
    found = sum(got[r[0]]["n_links"] for r in rows)
    assert 0.9 * degree.sum() <= found <= degree.sum()
    assert all(got[r[0]]["n_links"] <= d for r, d in zip(rows, degree, strict=True))
    best = components_of([(rows[i][0], rows[j][0]) for i, j in links], [r[0] for r in rows])
    assert np.mean([got[r[0]]["component_id"] == best[r[0]] for r in rows]) >= 0.97
    assert all(got[r[0]]["kept"] == (got[r[0]]["component_id"] == r[0]) for r in rows)
    assert itq_dedup.vector_groups(vectors(spark, [])).count() == 0


def test_vectors_that_share_an_id_are_separate(spark):
    one, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(7, one, 1), (7, other, 1), (3, one, 1), (8, [1.0, 0.01, 0.0], 1), (9, [0.01, 1.0, 0.0], 1), (10, other, 2)]
    got = sorted(tuple(r) for r in itq_dedup.vector_groups(vectors(spark, rows)).collect())
    assert got == [(3, 2, 3, True), (7, 1, 7, True), (7, 2, 3, False), (8, 2, 3, False), (9, 1, 7, False), (10, 0, 10, True)]


def test_vectors_of_rare_lengths_are_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(itq_dedup, "FITTED_WIDTHS", 1)
    monkeypatch.setattr(itq_dedup, "PART_ROWS", 8)
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(5) + rng.normal(size=5)).tolist(), i % 2) for i in range(60)]
    for width in (2, 3, 4):
        rows += [(100 * width + i, (np.ones(width) + 0.4 * rng.normal(size=width)).tolist(), i % 2) for i in range(30)]
    links = [(i, j) for i, j in vector_truth(rows, 0.93) if len(rows[i][1]) < 5]
    degree = np.zeros(len(rows), int)
    for pair in links:
        degree[list(pair)] += 1
    got = {r["vec_id"]: r for r in itq_dedup.vector_groups(vectors(spark, rows)).collect()}
    best = components_of([(rows[i][0], rows[j][0]) for i, j in links], [r[0] for r in rows])
    for row, d in zip(rows, degree, strict=True):
        if len(row[1]) < 5:
            assert (got[row[0]]["n_links"], got[row[0]]["component_id"]) == (d, best[row[0]])


# ---- 4: fingerprints ---------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one two", "A b C", "É a\xa0b\x0bc d", "x y z " * 500])
def test_fingerprint(text):
    assert golay_simhash.fingerprint(text) == plain_fingerprint(text)


def test_golay_keys_meet():
    index = golay_simhash.GolayIndex()
    assert (index.errors[:, 0] >= 0).all()  # perfect: every word decodes
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    stored, probing = {}, {}
    for into, fps, probe in ((stored, a, False), (probing, b, True)):
        for row, key in zip(*golay_simhash.segment_keys(fps, index, probe), strict=True):
            into.setdefault(row, set()).add(key)
    assert all(stored[i] & probing[i] for i in range(len(a)))


def test_simhash_groups(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        text = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
        rows.append((10 * i + 5, text))
        for j in range(i % 5):
            words = text.split()
            words[rng.randrange(120)] = "changed"
            rows.append((10 * i + 5 - j - 1, " ".join(words) if j else text.upper()))
    rows += [(900, None), (901, ""), (902, " "), (None, rows[0][1]), (5, rows[0][1])]
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    group = components_of(links, range(len(rows)))
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[group[i]] = min(doc, smallest.get(group[i], doc))
    want = sorted((str(rows[i][0]), f"{prints[i]:016x}", smallest[group[i]]) for i in range(len(rows)))
    got = golay_simhash.simhash_groups(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    assert golay_simhash.simhash_groups(docs(spark, [])).count() == 0


# ---- 5: urls -----------------------------------------------------------------


def test_url_verdicts(spark):
    link = '<html><LINK href="{}" rel=canonical></html>'.format
    rows = [
        (1, "http://A.example.com/en/1?x#y", None),
        (2, "http://www.example.com/en/1", None),
        (3, "http://b.net/fr/2", None),
        (4, "http://b.org/1", link("//b.net/fr/2#top")),
        (5, "https://b.org/2", '<meta http-equiv="Refresh" content="0; url=/1">'),
        (6, "http://c.org/1", link("http://c.net/es/1")),
        (7, "http://c.org/2", link("http://c.org/1")),
        (8, "http://c.org/1", link("http://x.com/")),
        (9, "nothing", link("http://b.net/fr/2")),
        (10, None, None),
        (11, "http://net/es", None),
        (12, "http://example.com", None),
        (13, "http://d.org/1", ""),
        (13, "http://d.org/1", ""),
        (None, "http://n.org/a?b", None),
        (15, "http://e.org/deep/page?q", link("other")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS own")
    moved = spark.createDataFrame([("http://d.org/1", "http://b.org/2"), (None, "http://d.org/1"), ("http://e.org/deep/other", "http://q.net/es/")], "from_url string, to_url string")
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in url_aliases.url_verdicts(pages, redirects=moved).collect()}
    assert got == {
        (1, "example.com/en/", "block"), (2, "www.example.com/en/", "allow"), (3, "net/fr/", "block"), (4, None, "block"),
        (5, None, "block"), (6, None, "allow"), (7, None, "allow"), (8, None, "allow"), (9, None, "allow"), (10, None, "allow"),
        (11, None, "allow"), (12, None, "allow"), (13, None, "block"), (None, None, "allow"), (15, None, "block"),
    }
    assert url_aliases.url_verdicts(pages.limit(0)).count() == 0


# ---- 6 and 10: tokens --------------------------------------------------------


def odd_texts():
    rng = random.Random(2)
    letters = list("abAB 'sStTre'vlLd \n\té漢▁<|>endoftext0123!$ΣσİßÁ\x1f\x85\xa0")
    return ["", " ", "x" * 3000, " " * 500, "漢" * 400, "a  b ▁ c " * 300, "don't I'LL <|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "İstanbul ΣΑΣ", "a\x1cb \x00", "aaaaaaa hhhhhh 12345 !!!!", "👩‍👩‍👧 ̈x"] + [
        "".join(rng.choices(letters, k=700)) for _ in range(40)
    ]


@pytest.mark.parametrize(("chunk", "overlap"), [(97, 3), (256, 64), (65_536, 1024)])
def test_resync_counts(chunk, overlap):
    encoder = resync_tokens.Encoder(tokenizer_path("piece_bpe_32k.model"))
    assert encoder.splits
    for text in odd_texts():
        assert resync_tokens.count_tokens(text, encoder, chunk, overlap) == len(encoder.model.encode(text))


def test_token_counts_edges(spark):
    got = resync_tokens.token_counts(docs(spark, odd_rows()), tokenizer_path("piece_bpe_32k.model"), most=2).collect()
    assert len(got) == 8
    assert {(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got if r["doc_id"] in (1, 2)} == {(0, 0, False)}


def test_pair_index_encoding():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), pair_index_bpe.PairIndexEncoder(path)
    for text, (ids, decoded) in zip(odd_texts(), own.encode(odd_texts()), strict=True):
        exact = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, exact))
        assert decoded == library.decode(exact, skip_special_tokens=False)


def test_encoded_edges(spark):
    path = tokenizer_path("word_bpe_49k.json")
    rows = pair_index_bpe.encoded(docs(spark, odd_rows()), path, digests=False).collect()
    assert len(rows) == 8 and [r["ids"] for r in rows if r["doc_id"] == 1] == [[]]
    assert pair_index_bpe.encoded(docs(spark, []), path).count() == 0


# ---- 8 and 9: mixing and sharding ----------------------------------------------


def fair_targets(sizes, weights, most=3):
    total, stopped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in stopped)
        open_weights = sum(w for i, w in enumerate(weights) if i not in stopped)
        target = [most * s if i in stopped else left * weights[i] / open_weights for i, s in enumerate(sizes)]
        above = {i for i, t in enumerate(target) if i not in stopped and t >= most * sizes[i]}
        if not above or len(stopped | above) == len(sizes):
            return target
        stopped |= above


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(systematic_mix, "GROUP_ROWS", 8)  # makes classes fall into hash ranges
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 80))), rng.choice(["b", "b", "b", "b", "a", "é", None])) for i in range(500)]
    rows += [(1000, "x y", "tiny"), (1001, "", "empty"), (1002, None, "b"), (3, rows[3][1], rows[3][2]), (None, "a b c", "a")]
    frame = docs(spark, rows)
    got = systematic_mix.mixed_sizes(frame).collect()
    names = sorted({r[2] for r in rows if r[2]}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == name) for name in names]
    targets = dict(zip(names, fair_targets(sizes, [i % 3 + 1 for i in range(len(names))]), strict=True))
    assert len(got) == len(rows)
    for name, size in zip(names, sizes, strict=True):
        own = [r for r in got if r["source"] == name]
        assert {r["source_size"] for r in own} == {size}
        assert {round(r["target"], 6) for r in own} == {round(targets[name], 6)}
        assert abs(sum(r["taken"] for r in own) - targets[name]) <= 3 * max(r["size"] for r in own)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in got)
    again = systematic_mix.mixed_sizes(frame.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = systematic_mix.mix(frame).collect()
    assert len(mixed) == sum(r["copies"] for r in got)
    assert systematic_mix.mixed_sizes(docs(spark, [])).count() == 0


def test_mix_of_rows_without_or_with_one_id(spark, monkeypatch):
    """A third of the rows have no id, many of one size, and a block of them are equal in every column."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 9))), "a") for i in range(300)]
    rows += [(None, " ".join(rng.choices(WORDS, k=4)), "a") for _ in range(90)] + [(None, "all the same", "a")] * 60
    rows += [(7, " ".join(rng.choices(WORDS, k=4)), "b") for _ in range(70)] + [(8, "b b", "b")] * 50 + [(9, None, None)] * 40
    frame = docs(spark, rows)
    plain = systematic_mix.mixed_sizes(frame).collect()
    plain_mix = sorted(map(str, systematic_mix.mix(frame).collect()))
    monkeypatch.setattr(systematic_mix, "GROUP_ROWS", 8)
    got = systematic_mix.mixed_sizes(frame).collect()
    assert sorted(map(str, got)) == sorted(map(str, plain))  # groups change no position
    assert sorted(map(str, systematic_mix.mixed_sizes(frame.repartition(5)).collect())) == sorted(map(str, got))
    mixed = sorted(map(str, systematic_mix.mix(frame).collect()))
    assert mixed == sorted(map(str, systematic_mix.mix(frame.repartition(5)).collect()))
    assert len(mixed) == len(plain_mix) == sum(r["copies"] for r in got)
    wide = systematic_mix.copies(frame)
    assert wide.columns == [*frame.columns, "size", "source_size", "target", "copies", "taken"]
    count = lambda found: sorted(((r["doc_id"], r["text"], r["source"]) for r in found), key=repr)
    assert count(wide.collect()) == count(frame.collect())


def test_minimax_search():
    rng = random.Random(1)
    for _ in range(500):
        n, k = rng.randint(1, 30), rng.randint(1, 8)
        loads = [rng.choice([1, 2, 50, rng.randint(1, 100)]) for _ in range(n)]
        ends = list(accumulate(loads))
        best = minimax_shards._smallest(ends, k)
        assert minimax_shards._greedy(ends, best, k)
        assert best == max(max(loads), -(-ends[-1] // k)) or minimax_shards._greedy(ends, best - 1, k) is None
        cuts = [0, *minimax_shards._even(ends, best, k), n]
        assert cuts == sorted(cuts) and max(sum(loads[a:b]) for a, b in zip(cuts, cuts[1:])) <= best


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(minimax_shards, "GROUP_ROWS", 7)
    monkeypatch.setattr(minimax_shards, "FIRST_DIGITS", 1)
    monkeypatch.setattr(minimax_shards, "MORE_DIGITS", 1)
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(40))) for _ in range(300)]
    rows = [(i, rng.choice(texts)) for i in range(600)] + [(700 + i, "same copy") for i in range(40)] + [(900, None), (901, ""), (None, "né"), (3, "né")]
    got = minimax_shards.shards(docs(spark, rows), 8).collect()
    assert len(got) == len(rows)
    by_text, loads = {}, {}
    text_of = {r[0]: r[1] for r in rows if r[0] != 3}
    for r in got:
        if r["doc_id"] in text_of:
            by_text.setdefault(text_of[r["doc_id"]] or "", set()).add(r["shard"])
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    import hashlib

    groups = {}
    for _, text in rows:
        key = hashlib.md5((text or "").encode()).hexdigest()
        groups[key] = groups.get(key, 0) + len((text or "").encode()) + 16
    ends = list(accumulate(groups[k] for k in sorted(groups)))
    assert max(loads.values()) == max(max(loads.values()), minimax_shards._smallest(ends, 8)) <= minimax_shards._smallest(ends, 8)
    for shard in loads:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert minimax_shards.shards(docs(spark, [])).count() == 0


def test_shards_of_rows_without_or_with_one_id(spark, monkeypatch):
    rows = [(i, f"text {i % 90}") for i in range(200)] + [(None, "hot")] * 80 + [(5, "hot")] * 30 + [(1000 + i, "hot") for i in range(40)]
    rows += [(None, None)] * 20 + [(None, "")] * 15
    frame = docs(spark, rows)
    plain = minimax_shards.shards(frame, 6).collect()
    monkeypatch.setattr(minimax_shards, "GROUP_ROWS", 7)
    got = minimax_shards.shards(frame, 6).collect()
    narrow = lambda found: sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in found), key=repr)
    assert narrow(got) == narrow(plain) and len(got) == len(rows)
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    again = minimax_shards.shards(frame.repartition(4), 6).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


# ---- registered queries and the pipeline ---------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    exact = con.sql(ORACLE_SQL[name]).to_arrow_table()
    got = QUERIES[name](spark, SF).toArrow()
    columns = sorted(got.column_names)
    assert columns == sorted(exact.column_names)
    rows = lambda table: sorted(zip(*(table[c].to_pylist() for c in columns), strict=True), key=repr)
    assert rows(got) == rows(exact)


def test_pipeline_stages(spark):
    import corpus_pipeline

    whole = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.reject_toxic(spark, whole, SF)
    assert clean.columns == corpus_pipeline.COLUMNS
    assert 0.7 * whole.count() <= clean.count() <= whole.count()
    good = corpus_pipeline.reject_poor(spark, whole, SF)
    assert 0.7 * whole.count() <= good.count() < whole.count()
    rows = whole.select("doc_id", "text").collect()
    group = jaccard_groups([r["text"] for r in rows])
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, whole, SF).collect())
    assert kept == sorted(min(rows[i]["doc_id"] for i in group if group[i] == g) for g in set(group.values()))
    mixed = corpus_pipeline.mix_sources(spark, whole, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS
    assert mixed.count() == sum(r["copies"] for r in systematic_mix.mixed_sizes(whole).collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality classifier", "SimHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"
    ]
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize(("cosine", "recall"), [(0.93, 0.95), (0.97, 0.99)])
def test_table_recall_at_a_given_cosine(cosine, recall):
    """Pairs at exactly the given cosine meet in at least one table this often."""
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(5000, 64)))
    across = rng.normal(size=a.shape)
    across = unit(across - (across * a).sum(axis=1, keepdims=True) * a)
    b = cosine * a + np.sqrt(1 - cosine**2) * across
    mean, projection = itq_dedup.fit_rotation(a)
    met = (itq_dedup.code_bytes(a, mean, projection) == itq_dedup.code_bytes(b, mean, projection)).any(axis=1)
    assert met.mean() >= recall


def shingle_set(text, size=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def jaccard_groups(texts, least=0.8):
    sets = [shingle_set(t) for t in texts]
    near = lambda a, b: len(a & b) >= least * len(a | b)
    return components_of([(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])], range(len(sets)))


def test_near_copies_against_brute_force_jaccard(spark):
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(900)}" for _ in range(150)]
        for _ in range(5):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.randrange(1, 4)):  # pairs on both sides of 0.8, and chains of pairs
                words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
    rows += [(1000, "One two"), (1001, "one  TWO"), (1002, "one two three")]
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows += [(2000 + r["doc_id"], r["text"]) for r in real]
    group = jaccard_groups([t for _, t in rows])
    want = {min(rows[j][0] for j in range(len(rows)) if group[j] == g) for g in set(group.values())}
    frame = docs(spark, rows).selectExpr("doc_id", "text", "'x' AS lang", "source", "length(text) AS n_chars")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame, SF).collect()} == want


def test_near_copies_leave_one_row_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(3))
    rows = [(7, a), (7, a), (7, a), (9, a + " end"), (None, a), (None, a.upper()), (None, b), (None, b), (None, b + " end"), (3, c), (4, c), (3, "other text")]
    frame = docs(spark, rows).selectExpr("doc_id", "text", "'x' AS lang", "source", "length(text) AS n_chars")
    for some in (frame, frame.repartition(3)):
        got = corpus_pipeline.drop_near_copies(spark, some, SF).collect()
        assert sorted((str(r["doc_id"]), r["text"][:5]) for r in got if r["doc_id"] is not None) == sorted([("7", a[:5]), ("3", c[:5]), ("3", "other")])
        assert [r["text"] in (b, b + " end") for r in got if r["doc_id"] is None] == [True]
    assert corpus_pipeline.drop_near_copies(spark, frame.limit(0), SF).count() == 0


def test_texts_of_one_template_stay(spark):
    """Texts that share passages but are no near copies all stay."""
    from siftline.llm import near_text

    rng = random.Random(5)
    template = [f"t{rng.randrange(500)}" for _ in range(160)]
    rows = []
    for i in range(2000):
        words = list(template)
        at = rng.randrange(70)
        words[at : at + 75] = [f"own{i}x{j}" for j in range(75)]  # about 0.37 alike
        rows.append((i, " ".join(words)))
    frame = docs(spark, rows)
    assert near_text.one_of_each(frame).count() == 2000


def test_links_of_a_bucket_are_fewer_than_its_rows():
    """A family in which most texts are about 0.7 alike: links join what brute force joins, and no pair is a row."""
    from siftline.llm import near_text

    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**62, 200).astype(np.uint64)
    sets = []
    for _ in range(240):
        own = base.copy()
        own[rng.choice(200, rng.integers(6, 40), replace=False)] = rng.integers(0, 2**62)
        sets.append(np.unique(own))
    sigs = np.stack([near_text.minima(x).astype(np.uint8) for x in sets])
    every = np.arange(len(sets))
    links = near_text.spanning_links(every, every, every, sigs, sets, 0.8)
    near = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    want = components_of([(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])], range(len(sets)))
    assert all(near(sets[a], sets[b]) for a, b in links) and len(links) < len(sets)
    assert components_of(links, range(len(sets))) == want


def test_sketches_pass_pairs_at_the_least_similarity():
    """At 0.8 a sketch rules a pair out less than once in a thousand."""
    from siftline.llm import near_text

    rng = np.random.default_rng(3)
    passed = 0
    for _ in range(400):
        words = [b"%d" % x for x in rng.integers(0, 10**6, 104)]
        other = list(words)
        other[50:52] = [b"x", b"y"]  # six of 100 shingles differ on either side: 94 / 106
        a, b = near_text.shingle_hashes(words), near_text.shingle_hashes(other)
        sigs = [near_text.minima(h).astype(np.uint8)[None] for h in (a, b)]
        passed += bool(near_text.alike(sigs[0][0], len(a), sigs[1], np.array([len(b)]), 0.8).all())
    assert passed == 400
    from math import comb

    agree, total = near_text.AGREE, near_text.BANDS * near_text.ROWS
    assert sum(comb(total, i) * 0.8**i * 0.2 ** (total - i) for i in range(agree)) < 1e-4


def test_encoding_holds_one_text_at_a_time():
    import tracemalloc

    encoder = pair_index_bpe.PairIndexEncoder(tokenizer_path("word_bpe_49k.json"))
    texts = ["some words come again and again " * 100] * 500
    tracemalloc.start()
    try:
        found = [len(ids.split()) for ids, _ in encoder.encode(texts)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 500 and len(set(found)) == 1 and found[0] >= 600
    assert peak < 4_000_000
